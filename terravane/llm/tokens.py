"""Token ids of whole texts by a public tokenizer, exact and with every distinct piece of text encoded once a task.

The tokenizer works on pieces that its own pattern cuts, each on its own, so a table from piece to ids, filled by the
tokenizer's model, gives the ids that it gives for the text. Texts outside the range where that pattern is restated here go to the tokenizer whole.
"""

from __future__ import annotations

import array
import os
import re

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame

from .common import blocks, text_bytes

#: The pattern of word_bpe_49k over Latin text, its letters and digits written out.
LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f"
DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^\s{LETTER}{DIGIT}]+"
#: Characters beyond these, and the tokenizer's special strings, are left to the tokenizer itself.
BEYOND = r"<\||[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u017f]"
MOST_PIECES = 200_000
END = 1


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes that can belong to a character beyond the pattern's range; texts without them need no closer look.
DOUBT = np.zeros(256, bool)
DOUBT[[*range(9), *range(14, 32), 127, 0xC2, 0xC4, *range(0xC6, 256)]] = True


def byte_symbols() -> dict[int, str]:
    """The character by which a byte-level model spells each byte: itself where it is visible, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.symbols = self.tokenizer.model, byte_symbols()
        self.pieces = re.compile(PIECE)
        self.beyond = re.compile(BEYOND)
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self.symbols)
        return array.array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def encode(self, texts: list[bytes], doubt: list[bool]) -> list[bytes]:
        """doubt: texts that hold bytes of DOUBT."""
        out = []
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        known, find, piece = self.known, self.pieces.findall, self.piece
        for raw, odd in zip(texts, doubt, strict=True):
            text = raw.decode("utf-8", "replace")
            if "<|" in text or odd and self.beyond.search(text):
                out.append(self.whole(text))
                continue
            found = find(text.lower())
            for p in set(found).difference(known):
                known[p] = piece(p)
            out.append(b"".join(map(known.__getitem__, found)))
        return out


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process' encoder for a tokenizer; it outlives a task, so pieces stay known."""
    from terravane.llm.tokens import _held as held  # the module's own: a task's functions may come with copies of their globals

    if path not in held:
        held.clear()
        held[path] = Encoder(path)
    return held[path]


def largest_id(path: str) -> int:
    """The largest id that the tokenizer can give."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


def encoded(batches, path: str, end: int = END):
    """(rows, ids of each row with the end id) over runs of about a megabyte of text."""
    held, last = encoder(path), np.array([end], "<u4").tobytes()
    for batch in batches:
        for a, b, data, offs in blocks(batch["b"]):
            doubt = np.diff(np.concatenate([[0], np.cumsum(DOUBT[data])])[offs]) > 0
            raw, cut = data.tobytes(), offs.tolist()
            ids = held.encode([raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)], doubt.tolist())
            yield batch.slice(a, b - a), [x + last for x in ids]


def pieces(docs: DataFrame, capacity: int, tokenizer: str = "word_bpe_49k.json", end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and ``end``, cut after every ``capacity`` ids.

    A null or empty text is the end id alone; texts are tokenized whole; repeated rows give repeated pieces.
    """
    path, step = tokenizer_path(tokenizer), 4 * capacity
    id_type = docs.schema["doc_id"].dataType.simpleString()
    extra = [("ids", pa.binary())] if keep_ids else []

    def run(batches):
        for rows, ids in encoded(batches, path, end):
            cuts = [(i, s, x[s : s + step]) for i, x in enumerate(ids) for s in range(0, len(x), step)]
            where = pa.array([i for i, _, _ in cuts], pa.int64())
            start = np.array([s for _, s, _ in cuts], np.int64) // 4
            out = [rows["doc_id"].take(where), pa.array((start // capacity).astype(np.int32)), pa.array(start), pa.array([len(x) // 4 for _, _, x in cuts], pa.int64()), pa.array([zlib.crc32(x) for _, _, x in cuts], pa.int64())]
            if keep_ids:
                out.append(pa.array([x for _, _, x in cuts], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", *[k for k, _ in extra]])

    rows = docs.select("doc_id", text_bytes().alias("b"))
    return rows.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else ""))
