"""SentencePiece encoding and decoding by a table of distinct chunks."""

from __future__ import annotations

import re
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm.common import table, with_columns

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Entries of the chunk table of a task; beyond, it starts anew (a cache, so results do not change). Longer chunks are
#: segmented each time and not kept, so the table stays below some 30 MB.
TABLE_ENTRIES = 150_000
KEPT_LENGTH = 64
_CHUNKS = re.compile(" +[^ ]*").findall


def _processor(model: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model if "/" in model else public_tokenizers.path(model))


def separable(processor) -> bool:
    """Whether no piece crosses from text into a white-space marker, and text is not normalised."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(processor.serialized_model_proto())
    norm = proto.normalizer_spec
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
    plain = plain and not proto.trainer_spec.treat_whitespace_as_suffix and proto.trainer_spec.model_type == pb.TrainerSpec.BPE
    return plain and not any(MARK in p.piece.lstrip(MARK) or p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in proto.pieces)


class ChunkTable(dict):
    """Marked chunk to its ids as little-endian 32-bit integers; each distinct chunk is segmented once."""

    def __init__(self, processor):
        super().__init__()
        self.encode = processor.encode
        self.mark = [processor.piece_to_id(MARK)]

    def __missing__(self, chunk: str) -> bytes:
        # The library puts one marker before a text: give it the chunk without its first one.
        packed = _pack(self.encode(chunk[1:]) if len(chunk) > 1 else self.mark)
        if len(chunk) <= KEPT_LENGTH:
            if len(self) >= TABLE_ENTRIES:
                self.clear()
            self[chunk] = packed
        return packed


def _pack(ids) -> bytes:
    import sys

    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, begin: bool = True, end: bool = True) -> DataFrame:
    """Add ``token_bytes`` (ids as little-endian unsigned 32-bit integers) and ``n_tokens``.

    The whole text is cut before every run of white-space markers. If the model
    lets no piece cross such a cut, every distinct chunk is segmented once and
    its ids are put back by position; otherwise the text is encoded whole. The
    table is one per task and bounded, so nothing is shuffled and one frequent
    word costs a lookup. A null text counts as empty: begin and end ids only.
    ``model`` is a path, or a name that the public tokenizer package resolves.
    """

    def make():
        processor = _processor(model)
        chunks = ChunkTable(processor)
        split = separable(processor)
        first = _pack([processor.bos_id()]) if begin else b""
        last = _pack([processor.eos_id()]) if end else b""

        def ids(t):
            if not t:
                return first + last
            if not split:
                return first + _pack(processor.encode(t)) + last
            return b"".join([first, *[chunks[c] for c in _CHUNKS(" " + t.replace(MARK, " "))], last])

        def of(texts):
            packed = [ids(t) for t in texts]
            return packed, [len(p) // 4 for p in packed]

        return of

    return with_columns(docs, [text], make, "token_bytes binary, n_tokens long")


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """Add ``decoded``, the text that the library makes of ``token_bytes`` (null: empty)."""

    def make():
        processor = _processor(model)

        def of(packed):
            return [[processor.decode(memoryview(p).cast("I").tolist()) if p else "" for p in packed]]

        return of

    return with_columns(tokens, ["token_bytes"], make, "decoded string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decode(encode(docs).select("doc_id", "token_bytes", "n_tokens"))
    return out.select(
        "doc_id", "n_tokens", F.sha2("token_bytes", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their tokens."""
    return encode(docs)
