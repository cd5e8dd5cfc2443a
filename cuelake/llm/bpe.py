"""BPE encoding and decoding through a table of distinct words.

Each task splits its texts into the tokenizer's words, encodes each distinct word once, and joins the ids back by
position; a text's ids become text again through the id-to-piece table, whose size the vocabulary bounds. No word
or position leaves the task: exchanging every position, as one table for the whole corpus needs, moves several times
the input (README has figures), while the distinct words of a task are a few hundred thousand.

Nulls and empty texts have no tokens, an empty decoded text and the digests of the empty string. Every row gives one
row, repeated rows too; null ids are kept; columns beside the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cuelake.llm import common
from cuelake.llm.words import TEXTS, WordTable, held, word_words

VOCABULARY = "word_bpe_49k.json"


class PieceTable(WordTable):
    """word -> (number of ids, decimal ids joined by a space); and decimal id -> piece."""

    limit = 150_000

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.pieces = {str(i): p for p, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}

    def entry(self, ids: list[int]) -> tuple[int, str]:
        return len(ids), " ".join(map(str, ids))

    def decode(self, ids: str) -> str:
        """The pieces, joined by a space, of decimal ids joined by a space."""
        return " ".join(map(self.pieces.__getitem__, ids.split()))

    def split(self, text: str) -> list[str]:
        return word_words(text, self.tokenizer)


def encode_texts(texts: list[str | None], path: str) -> list[tuple[str, str, int]]:
    """Ids and the text decoded from them, both joined by a space, and how many ids, of each text."""
    table, out = held(PieceTable, path), []
    for text in texts:
        some = [e for e in table.encode(text or "") if e[0]]
        ids = " ".join([e[1] for e in some])
        out.append((ids, table.decode(ids), sum([e[0] for e in some])))
    return out


def decode(ids: list[int], vocabulary: str | None = None) -> str:
    """The text of an id array: its pieces joined by a space."""
    return held(PieceTable, common.tokenizer_path(VOCABULARY, vocabulary)).decode(" ".join(map(str, ids)))


def _mapped(df: DataFrame, id_col: str, text_col: str, path: str, row, schema: str, kinds: pa.Schema) -> DataFrame:
    """row(id, ids, decoded, how many) of each of df's rows, TEXTS at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                keys, texts = (c.to_pylist() for c in batch.slice(at, TEXTS).columns)
                rows = [row(k, *x) for k, x in zip(keys, encode_texts(texts, path), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return df.select(df[id_col], df[text_col]).mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string), a row for each of df's."""
    kinds = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    return _mapped(df, id_col, text_col, common.tokenizer_path(VOCABULARY, vocabulary), lambda key, ids, decoded, n: (key, [int(x) for x in ids.split()], decoded), f"{id_col} long, ids array<int>, decoded string", kinds)


def digests(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() with the two strings digested where they are made."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _mapped(df, "doc_id", "text", common.tokenizer_path(VOCABULARY, vocabulary), lambda key, ids, decoded, n: (key, n, hashlib.sha256(ids.encode()).hexdigest(), common.sha256(decoded)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", kinds)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.load(spark, sf_dir, "documents"))
