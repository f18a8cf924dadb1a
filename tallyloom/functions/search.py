"""Many fixed strings in many texts: an Aho-Corasick automaton in Arrow batches.

The needles are split by hash into parts of at most ``PART_BYTES``, whose number follows from their counted
size; each part is one broadcast and one pass over the texts, so no number of needles is too large and no
broadcast grows with them. A worker builds a part's automaton once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the needles of one automaton (which takes some ten times as much memory).
PART_BYTES = 8 << 20


class Needles:
    """Needles as a worker gets them; the automaton is made where it is first asked for."""

    def __init__(self, values: list[str]):
        self.values = values

    def __getstate__(self):
        return {"values": self.values}

    @property
    def automaton(self):
        if "made" not in self.__dict__:
            import ahocorasick

            self.made = ahocorasick.Automaton()
            for value in self.values:
                self.made.add_word(value, value)
            self.made.make_automaton()
        return self.made

    def found(self, text: str) -> list[str]:
        """The needles that occur in the text, each once, in order."""
        return sorted({value for _, value in self.automaton.iter(text)}) if self.values and text else []


def contained(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "needle", found: str = "found") -> DataFrame:
    """A row of texts for every needle that its text contains, ignoring case, wherever it stands, with the needle in lower case.

    Each needle of a text is told once; a null text or needle, and an empty needle, is found nowhere. Rows of texts
    that are repeated are told each.
    """
    import pyarrow as pa

    spark = texts.sparkSession
    wanted = needles.select(F.lower(F.col(needle)).alias("n")).where(F.col("n") != "").distinct()
    size = wanted.agg(F.sum(F.octet_length("n") + 64)).first()[0] or 0
    parts = -(-size // PART_BYTES)
    schema = texts.withColumn(found, F.lit("")).schema
    out = None
    for part in range(parts):
        mine = wanted.where(F.pmod(F.xxhash64("n"), F.lit(parts)) == part).collect()  # about PART_BYTES
        shared = spark.sparkContext.broadcast(Needles([r.n for r in mine]))

        def run(batches, shared=shared):
            for batch in batches:
                at, hits = [], []
                for i, low in enumerate(batch.column(batch.num_columns - 1)):
                    for hit in shared.value.found(low.as_py()):
                        at.append(i)
                        hits.append(hit)
                rows = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(hits, pa.string())], names=[*schema.names])

        hit = texts.withColumn("_low", F.lower(F.col(text))).mapInArrow(run, schema)
        out = hit if out is None else out.unionByName(hit)
    return texts.withColumn(found, F.lit("")).limit(0) if out is None else out
