"""One configuration for sketching, comparing and indexing texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import columns as C
from corpusloom.functions import udfs as U
from corpusloom.functions.columns import Config
from corpusloom.operators import lsh


class Sketcher:
    """Sketches of texts under a :class:`Config`; signatures compare only at equal k and seed."""

    def __init__(self, config: Config | None = None):
        self.config = config or Config()

    def sketch(self, text: Column) -> Column:
        """Signature of a string or binary column; null for null."""
        return U.sketch(text, self.config.w, self.config.k, self.config.seed)

    def similarity(self, a: Column, b: Column) -> Column:
        """Estimated Jaccard similarity of two texts; 0 if either has no shingles."""
        return C.similarity(self.sketch(a), self.sketch(b))

    def containment(self, a: Column, b: Column) -> Column:
        """Estimated share of a's shingles that b has; 0 if either has none."""
        return C.text_containment(self.sketch(a), self.sketch(b))

    def signatures(self, docs: DataFrame) -> DataFrame:
        """(id, seq, sig) of (id, seq, text)."""
        return docs.select("id", "seq", self.sketch(F.col("text")).alias("sig"))

    def index(self, docs: DataFrame, drop_empty: bool = False) -> DataFrame:
        return lsh.band_table(self.signatures(docs), *self._bands(), drop_empty=drop_empty)

    def query(self, index: DataFrame, queries: DataFrame) -> DataFrame:
        return lsh.index_query(index, self.signatures(queries), *self._bands())

    def verified_query(self, docs: DataFrame, queries: DataFrame, least: float = 0.0) -> DataFrame:
        return lsh.verified_query(self.signatures(docs), self.signatures(queries), *self._bands(), least)

    def similarity_join(self, docs: DataFrame, least: float, drop_empty: bool = False) -> DataFrame:
        return lsh.similarity_join(self.signatures(docs), *self._bands(), least, drop_empty)

    def _bands(self) -> tuple[int, int]:
        if not self.config.bands or not self.config.rows:
            raise ValueError("an index needs bands and rows")
        return self.config.bands, self.config.rows
