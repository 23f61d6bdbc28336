"""Token counts of a byte-pair vocabulary, by merging with a heap over a linked list.

The lowest-ranked adjacent pair (ties: the leftmost) is popped and merged until none is left; a text has as many
tokens as initial symbols minus merges, and no identifiers are made. Characters outside the vocabulary count as
their UTF-8 bytes. A model that asks for more (another normaliser, no byte fallback) is an error. As no piece holds a space after another character, a text falls into independent chunks (spaces
and what follows); each worker remembers the counts of chunks in two generations of bounded size.

Defined results: a null or empty text has no tokens; repeated rows each get their result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracery.llm.grid import column, kept, runs
from tracery.llm.tables import id_and_text, id_field

#: Chunks that a worker remembers, and the longest that it does.
REMEMBERED = 600_000
_LONGEST = 64
_SPACE = "▁"
_CHUNK = re.compile(" *[^ ]+| +")


class MergeCounter:
    """Counts the tokens of texts under one SentencePiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        normal = spec.normalizer_spec
        as_is = not normal.precompiled_charsmap and normal.add_dummy_prefix and not normal.remove_extra_whitespaces and normal.escape_whitespaces
        if not as_is or not spec.trainer_spec.byte_fallback or spec.trainer_spec.model_type != spec.trainer_spec.BPE or any(p.type == p.USER_DEFINED for p in spec.pieces):
            raise ValueError("counted are BPE models with byte fallback, a space put before the text, and no other normalisation")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.rank = {p: -model.get_score(model.piece_to_id(p)) for p in pieces}
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("pieces with inner spaces: texts don't fall into chunks")
        self.single = {p for p in pieces if len(p) == 1}
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def merged(self, symbols: str) -> int:
        """Tokens of a chunk whose spaces are already pieces' spaces."""
        n, rank = len(symbols), self.rank
        text, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, p) for i in range(n - 1) if (r := rank.get(p := symbols[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not text[i] or j >= n or len(text[i]) + len(text[j]) != len(pair) or text[i] + text[j] != pair:
                continue  # one of the two was merged meanwhile
            text[i], text[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(p := pair + text[k])) is not None:
                    heapq.heappush(heap, (r, i, p))
            if (h := before[i]) >= 0 and (r := rank.get(p := text[h] + pair)) is not None:
                heapq.heappush(heap, (r, h, p))
            merges += 1
        spelled = sum(len(c.encode()) - 1 for c in text if len(c) == 1 and c not in self.single)
        return n - merges + spelled

    def remember(self, chunk: str) -> int:
        n = self.old.get(chunk)
        if n is None:
            n = self.merged(chunk.replace(" ", _SPACE))
        if len(chunk) <= _LONGEST:
            self.young[chunk] = n
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = f" {text.replace(_SPACE, ' ')}"
        total, young = 0, self.young.get
        for chunk in _CHUNK.findall(text):
            n = young(chunk)
            if n is None:
                n = self.remember(chunk)
                young = self.young.get
            total += n
        return total


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(("counter", model_path), lambda: MergeCounter(model_path))
        for run in runs(batches, keep=True):
            texts = column(run, "text")
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": column(run, "doc_id"), "n_bytes": size, "n_tokens": pa.array([counter.count(t.as_py()) for t in texts], pa.int64())})

    counted = T.StructType([id_field(docs, id_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return id_and_text(docs, id_col, text_col).mapInArrow(count, counted).withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tracery.llm.tables import read

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
