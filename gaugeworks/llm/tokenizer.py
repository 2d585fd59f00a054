"""Token ids of whole texts by the tokenizers library.

The word-level tokenizer used here drops white space, so the ids of a text are the ids of its
white-space separated chunks, one after the other.  Each distinct chunk is encoded once for a
Python worker and kept in a bounded table; a text is then a gather of table entries.  Chunks of
plain characters are cut into the tokenizer's own word classes and given to its BPE model; any
other chunk goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Entries that a worker's table holds before it starts afresh.
TABLE_ENTRIES = 400_000
#: Text that is cut up at a time.
BATCH_BYTES = 6 << 20
PACK = [struct.Struct(f"<{n}H") for n in range(64)]

#: Fixed values of the tokenizer file word_bpe_49k.json: its split pattern on characters that need no
#: normalising but lower case (printable ASCII and the letters of Latin-1).
PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {**{b: chr(b) for b in kept}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class ChunkIds(dict):
    """chunk (bytes without white space) -> its ids as little-endian unsigned 16-bit integers."""

    def __init__(self, path: str, specials_are_text: bool = False):
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = specials_are_text
        if self.whole.get_vocab_size() > 65536:
            raise ValueError("ids must fit 16 bits")
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        if ((text.isascii() and text.isprintable()) or PLAIN.fullmatch(text)) and not ("<|" in text and any(s in text for s in SPECIAL)):
            ids = b"".join([self.pieces.get(p) or self._piece(p) for p in PIECES.findall(text.lower())])
        else:
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        if len(chunk) < 64:
            self[chunk] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(letters)]
        packed = PACK[len(ids)].pack(*ids) if len(ids) < len(PACK) else np.array(ids, "<u2").tobytes()
        if len(piece) < 64:
            self.pieces[piece] = packed
        return packed

    def batch(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of the rows one after the other, ids of each row) for runs of rows of about BATCH_BYTES; null: empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        row = 0
        while row < len(texts):
            end = max(row + 1, int(np.searchsorted(sizes, sizes[row] + BATCH_BYTES, "right")) - 1)
            yield row, *self._rows(texts.slice(row, end - row))
            row = end

    def _rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > TABLE_ENTRIES:
            self.clear()
        if len(self.pieces) > TABLE_ENTRIES:
            self.pieces.clear()
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        ids = [self[w] for w in words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)]
        width = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        flat, first = np.frombuffer(b"".join(ids), "<u2"), np.cumsum(width) - width
        at = words.indices.to_numpy(zero_copy_only=False)
        each = width[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        out = flat[np.repeat(first[at] - ends[:-1], each) + np.arange(ends[-1])]
        offsets = lists.offsets.to_numpy(zero_copy_only=False)
        return out, np.diff(ends[offsets - offsets[0]])


_tables: dict[tuple[str, bool], ChunkIds] = {}


def chunk_ids(path: str, specials_are_text: bool = False) -> ChunkIds:
    """This worker's table."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (path, specials_are_text)
    if key not in _tables:
        _tables[key] = ChunkIds(path, specials_are_text)
    return _tables[key]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file; the same on driver and executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
