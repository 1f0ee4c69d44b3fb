"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the model has a white-space marker after another character, no merge can cross from a character to a
marker, so a text's ids are those of its marked words one after the other. Each batch segments every distinct marked
word once with the library and joins the ids back by position. A line feed that stands in no piece of the vocabulary
bounds chunks likewise. A model without these properties is run on whole texts.

Defined results: a null text is an empty one, which has only the begin and end ids; rows that repeat give a row each; an
empty table gives an empty result; other columns pass through untouched, but columns of the outputs' names are replaced.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lanternfold.llm.common import quoted, whole_text, with_results

MARK = "▁"
#: Chunks that a task's table holds before it starts anew: bounds memory, not results.
TABLE_CHUNKS = 200_000


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def unpacked(ids: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


class ChunkCodec:
    """Encodes and decodes exactly as the library does with one model."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i))]
        plain = self.sp.encode("a  b ", out_type=str)
        keeps_spaces = "".join(plain).replace(MARK, " ") == " a  b "
        self.chunked = keeps_spaces and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        line_feed = "" if any("\n" in p for p in pieces) or self.sp.encode("\na", out_type=str)[:1] != [MARK] else r"\n"
        self.chunks = re.compile(rf" +[^ {line_feed}]*" + (r"|\n[^ \n]*" if line_feed else ""))
        self.mark_id = self.sp.piece_to_id(MARK)
        self.begin, self.end = packed([self.sp.bos_id()]), packed([self.sp.eos_id()])
        self.table: dict[str, bytes] = {}

    def _segment(self, new: list[str]) -> None:
        # the library adds one marker before each text; a chunk of blanks brings one of its own
        for chunk, ids in zip(new, self.sp.encode([c[1:] if c[0] == " " else c for c in new], num_threads=1), strict=True):
            self.table[chunk] = packed(ids if chunk[0] == " " and len(chunk) > 1 else [self.mark_id] if chunk[0] == " " else ids[1:])

    def encode_packed(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, with begin and end ids, as little-endian 32-bit numbers."""
        for text in texts:
            if not self.chunked:
                yield self.begin + packed(self.sp.encode(text)) + self.end
                continue
            chunks = self.chunks.findall(" " + text.replace(MARK, " ")) if text else []
            table = self.table
            new = [c for c in dict.fromkeys(chunks) if c not in table]
            if len(table) + len(new) > TABLE_CHUNKS:
                table.clear()
                new = list(dict.fromkeys(chunks))
            if new:
                self._segment(new)
            yield b"".join([self.begin, *map(table.__getitem__, chunks), self.end])

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text, with begin and end ids."""
        for ids in self.encode_packed(texts):
            yield unpacked(ids)

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def encode_documents(docs: DataFrame, model_file: str, text_col: str = "text", keep_ids: bool = False, keep_decoded: bool = False) -> DataFrame:
    """``docs`` without the text, with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int) and decoded."""
    results = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *[("ids", "array<int>")] * keep_ids, *[("decoded", "string")] * keep_decoded]

    def worker() -> Callable[[list[str]], list[pa.Array]]:
        import numpy as np

        codec = ChunkCodec(model_file)

        def make(texts: list[str]) -> list[pa.Array]:
            n, ids_sha, decoded_sha, all_ids, all_decoded = [], [], [], [], []
            for ids in codec.encode_packed(texts):
                decoded = codec.decode(unpacked(ids))
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(np.frombuffer(ids, "<i4"))
                if keep_decoded:
                    all_decoded.append(decoded)
            out = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            return out + [pa.array(all_ids, pa.list_(pa.int32()))] * keep_ids + [pa.array(all_decoded, pa.string())] * keep_decoded

        return make

    return with_results(docs, whole_text(quoted(text_col)), [text_col, "ids", "decoded"], results, worker)
