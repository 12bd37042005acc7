"""Token counts: SentencePiece encoding in Arrow functions that return lengths only.

Rows stay in their partition (no shuffle). Inside a task the texts are cut into parts at safe
boundaries and encoded in batches of about equal bytes, so one very long text does not make one
very long encoder call.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_slices, in_parts, vocabulary_bytes, whole_texts

BATCH_BYTES = 1 << 20
PART_BYTES = 32 << 10
_MARK = "▁"                   # how the vocabulary writes a space; in a text it counts as one
_SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def _encoder(model: bytes):
    """The encoder, and whether a text may be cut at single spaces: pieces never hold a space after
    another character, white space is kept as it is, and each text gets one space in front, which
    stands for the one that the cut takes away. Then no piece can span the cut."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    inner = any(_MARK in p.lstrip(_MARK) for p in map(sp.id_to_piece, range(sp.get_piece_size())))
    space, spaces = (sp.encode(x, out_type=str) for x in ("a b", "a  b"))
    exact = (sp.encode(" a", out_type=str), "".join(space), "".join(spaces)) == (
        [_MARK, _MARK + "a"], f"{_MARK}a{_MARK}b", f"{_MARK}a{_MARK}{_MARK}b")
    return sp, exact and not inner


def split_at_spaces(text: str, part: int) -> list[str]:
    """Parts of ``part`` characters or somewhat more; each cut drops one space that stands between
    two characters that are no spaces. Without such a space the rest stays whole."""
    out, start = [], 0
    for m in re.finditer(rf"(?<=[^ {_MARK}]) (?=[^ {_MARK}])", text):
        if m.start() - start >= part:
            out.append(text[start:m.start()])
            start = m.end()
    out.append(text[start:])
    return out


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows stay; an empty table gives no
    row. Very long texts are cut at safe boundaries (see ``split_at_spaces``) when the vocabulary
    allows it and are encoded whole otherwise; either way the count is the library's own. Other columns are not read."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(vocabulary_bytes(model_path))

    def run(batches):
        sp, can_cut = _encoder(model.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = pa.compute.binary_length(batch.column("text")).to_pylist()
            parts, owner, part_sizes = [], [], []
            for i, (t, n) in enumerate(zip(texts, sizes)):
                for p in split_at_spaces(t, PART_BYTES) if can_cut and n > 2 * PART_BYTES else (t,):
                    parts.append(p)
                    owner.append(i)
                    part_sizes.append(n if p is t else len(p))
            counts = [0] * len(texts)
            for a, b in byte_slices(parts, part_sizes, BATCH_BYTES):
                for i, ids in zip(owner[a:b], sp.encode(parts[a:b], num_threads=1)):
                    counts[i] += len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401  (pa.compute)
    counted = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(in_parts(run), _SCHEMA)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
