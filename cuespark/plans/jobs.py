"""The callers' own models over batches of rows, and jobs composed of operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.functions.text import apply_phrase_table
from cuespark.operators.expand import in_slices
from cuespark.operators.grouping import finalize_cues
from cuespark.operators.joins import apply_corrections
from cuespark.operators.sequence import sample_context


def apply_model(df: DataFrame, f: Callable, schema: str, batch: int = 64, setup: Callable | None = None, group: str | None = None) -> DataFrame:
    """``f(model, frame)`` over frames of at most ``batch`` rows; ``setup`` makes the model once a partition.

    ``f`` returns the columns of ``schema``. A frame that fails is tried row by row; a row that
    fails keeps nulls and its message in ``error``. ``group`` keeps rows of a profile together.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    dealt = df.repartition(group) if group else df

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = setup() if setup else None

        def one(part: pd.DataFrame) -> pd.DataFrame:
            try:
                out = f(model, part).reset_index(drop=True)
                return pd.concat([part.reset_index(drop=True), out[names]], axis=1).assign(error=None)
            except Exception as e:  # the caller's code may fail on any row
                if len(part) > 1:
                    return pd.concat([one(part.iloc[k : k + 1]) for k in range(len(part))])
                return part.reset_index(drop=True).assign(**dict.fromkeys(names), error=str(e)[:500])

        for frame in frames:
            for k in range(0, len(frame), batch):
                yield one(frame.iloc[k : k + batch])

    fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema)
    return dealt.mapInPandas(run, f"{fields}, {schema}, error string")


def apply_blocks(
    df: DataFrame, f: Callable[[list[str]], list[str]], block: int, least: int = 1, text: str = "text", key: str = "media_id", on_fail: str = "keep", tries: int = 1, halve: bool = True, accept: Callable[[str, str], bool] | None = None
) -> DataFrame:
    """``reply`` of ``f`` over blocks of rows in order, ``kept`` where a row has none of its own, ``error`` why.

    A block that fails (an error, another number of replies, or one that ``accept(text, reply)``
    refuses) is asked ``tries`` times, then in halves down to ``least`` rows, or without ``halve``
    row by row at once. What fails still, by ``on_fail``: ``keep`` gives rows their own text,
    ``null`` no reply, for a placeholder, ``raise`` ends the job. Blocks are cut where they are, so
    there are no further passes over the data, and many of them go to Python in one Arrow batch.
    """
    if on_fail not in ("keep", "null", "raise"):
        raise ValueError(f"on_fail must be keep, null or raise, not {on_fail}")
    numbered = df.withColumn("__block", F.floor((F.col("cue_no") - 1) / block))

    def run(numbers: list[int | None], texts: list[str | None]) -> list[dict]:
        order = sorted(range(len(texts)), key=lambda k: (numbers[k] is None, numbers[k]))

        def ask(texts: list[str]) -> list[tuple[str | None, bool, str | None]]:
            why = None
            for _ in range(tries):
                try:
                    out = list(f(texts))
                    why = None if len(out) == len(texts) else f"BLOCK_COUNT_MISMATCH {len(out)} of {len(texts)}"
                    if why is None and accept and not all(map(accept, texts, out)):
                        why = "refused"
                except Exception as e:  # the caller's code may fail on any block
                    why = str(e)[:500] or type(e).__name__
                if why is None:
                    return [(x, False, None) for x in out]
            if len(texts) > least and len(texts) > 1:
                step = (len(texts) + 1) // 2 if halve else 1
                cuts = [texts[: len(texts) // 2], texts[len(texts) // 2 :]] if halve else [texts[k : k + step] for k in range(0, len(texts), step)]
                return [x for t in cuts for x in ask(t)]
            if on_fail == "raise":
                raise RuntimeError(f"{why}: {texts[0][:200] if texts[0] else ''}")
            return [(t if on_fail == "keep" else None, True, why) for t in texts]

        got = dict(zip(order, ask([texts[k] for k in order]), strict=True))
        return [dict(zip(("reply", "kept", "error"), got[k], strict=True)) for k in range(len(texts))]

    blocks = numbered.groupBy(key, "__block").agg(F.collect_list(F.struct(*df.columns)).alias("__rows"))
    replies = in_slices(run, "array<struct<reply:string,kept:boolean,error:string>>", F.col("__rows.cue_no"), F.col("__rows")[text])
    return blocks.withColumn("__got", replies).select(F.inline(F.arrays_zip("__rows", "__got"))).select("__rows.*", "__got.*")


def correct_tracks(cues: DataFrame, glossary: Callable[[DataFrame], DataFrame], correct: Callable[[list[str]], list[str]], block: int = 40, leaks: tuple[str, ...] = (), summaries: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(corrected cues, (media_id, rule, n) of what was done): tracks (media_id, cue_no, start_ms, end_ms, text).

    A glossary from a sample of each track is applied to that track, then the caller's corrections
    under a guard, then the glossary again; near duplicates, leaks and summaries are cleaned up at
    the end. ``glossary`` makes (media_id, wrong, correct) of the sample, whose budget bounds the phrases of a track.
    """
    phrases = glossary(sample_context(cues))
    fixed = apply_phrase_table(cues, phrases, by=["media_id"], changed="by_glossary")
    replies = apply_blocks(fixed, correct, block).where("not kept").select("media_id", "cue_no", F.lit(1).alias("seq"), F.col("reply").alias("fixed"))
    longest = F.greatest(F.length("text") + 28, F.floor(F.length("text") * 1.75) + 8)
    corrected = apply_corrections(fixed.drop("by_glossary"), replies, (F.trim("fixed") != "") & ~F.col("fixed").contains("\n") & (F.length("fixed") <= longest))
    kept, struck = finalize_cues(apply_phrase_table(corrected.select(cues.columns), phrases, by=["media_id"]), leaks, summaries)
    mapped = fixed.where("by_glossary").groupBy("media_id").agg(F.count(F.lit(1)).alias("n")).select("media_id", F.lit("glossary").alias("rule"), "n")
    return kept, struck.unionByName(mapped)
