"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The ids of a text are the best path through the lattice of its pieces: the pieces' scores add up, and of equal
sums the path whose last piece starts first wins. A piece's score is the logarithm of its probability by the
Zipf-Mandelbrot law, log 1/(rank + ZIPF), from the rank that its model gives it; nothing is trained.

One search goes through a whole text, which it is fed in slices. It keeps a window: a new piece can start only at
one of the last `longest` boundaries, so only those can still be on the best path. Following their backpointers, all
surviving paths soon meet at one boundary; ids before it are certain, are committed at once and forgotten. Memory is
bounded by the window and the stretch until paths meet, not by the text. (In a text that repeats a few letters
without a break, paths of different phase may never meet; then one backpointer a character is kept, and looks for a
meeting get rarer, so that time stays linear.)

Where no piece of the vocabulary reaches over a boundary, all paths meet there for certain. Stretches between such
boundaries recur (most are words): when the window is closed and the next whole stretch is a remembered one, its
ids are committed without walking through its characters again.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import slices, table

SPACE = "▁"
#: Stretches a worker remembers, and the longest that it does.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 48
#: Scores are whole millionths, so sums are exact and ties are ties.
MILLION = 1_000_000
#: An unknown character costs so much more than the worst piece.
UNKNOWN_PENALTY = 10 * MILLION
#: Added to ranks: pieces of low rank are about as frequent as each other.
ZIPF = 300
#: Characters of a text that are fed at once.
SLICE_CHARS = 1 << 14
#: Stands for a SPACE that the text itself holds: a private character that no piece has.
LITERAL = "\ue000"


class Vocabulary:
    """Pieces of a model that keeps texts as they are (white space becomes SPACE, one SPACE is put before)."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" a  b ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}":
            raise ValueError("the model changes texts before it cuts them; they could not be decoded exactly")
        self.pieces: dict[str, int] = {}
        self.score: list[int] = []
        self.byte_id = [None] * 256
        self.raw: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.score.append(-round(MILLION * math.log(ZIPF - min(model.get_score(i), 0.0))))
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.pieces[piece] = i
                self.raw.append(piece.replace(SPACE, " ").encode())
        if None in self.byte_id:
            raise ValueError("a model without all byte pieces cannot encode every text")
        self.longest = max(map(len, self.pieces))
        self.unknown = min(self.score[i] for i in self.pieces.values()) - UNKNOWN_PENALTY
        self.trie: dict = {}
        for piece, i in self.pieces.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        joined = sorted({c for p in self.pieces if len(p) > 1 for c in p} - {SPACE})
        inner = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        # no piece reaches over the start of a run of SPACE, or over either side of a character that stands in no longer piece
        chars = re.escape("".join(joined))
        self.cut = None if inner else re.compile(f"{SPACE}*[{chars}]+|{SPACE}+|[^{SPACE}{chars}]")
        self.rest = None if inner else (re.compile(f"{SPACE}*[{chars}]*"), re.compile(f"[{chars}]*"))

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode()]


class StreamingViterbi:
    """feed() takes characters and returns ids that are certain; finish() returns the rest.

    `literal` stands for a SPACE that the text itself holds: it is no white space and becomes bytes. `memory` holds the
    ids of stretches that were walked before; the stretch at the end of a slice is held back, or walked if it is long.
    """

    def __init__(self, vocabulary: Vocabulary, literal: str = LITERAL, memory: dict[str, list[int]] | None = None):
        self.v, self.literal, self.memory = vocabulary, literal, {} if memory is None else memory
        self._start()

    def _start(self) -> None:
        self.base = 0  # the boundary that paths met at last; the lists begin there
        self.best: list[int] = [0]
        self.back: list[tuple[int, int | str] | None] = [None]  # (boundary before, piece id or unknown character)
        self.alive: list[tuple[int, dict]] = []  # where pieces that the text still spells began, and how far they are in the trie
        self.look = 4 * self.v.longest  # open boundaries at which paths are followed back next
        self.held = ""  # the beginning of a stretch that may go on in the next slice
        self.open = None  # the pattern of what goes on with a stretch that is half walked
        self.commits = 0

    def feed(self, chars: str) -> list[int]:
        if self.v.cut is None:  # a vocabulary without certain boundaries
            return self._walk(chars)
        out: list[int] = []
        if self.open is not None:
            rest = self.open.match(chars).group()
            out += self._walk(rest)
            if len(rest) == len(chars):
                self._note(rest)
                return out
            out += self._close()
            chars = chars[len(rest):]
        stretches = self.v.cut.findall(self.held + chars)
        self.held = stretches.pop() if stretches else ""
        known = self.memory.get
        for stretch in stretches:
            ids = known(stretch)
            if ids is None:
                ids = self._stretch(stretch)
            else:
                self.commits += 1
            out += ids
        if len(self.held) > REMEMBERED_CHARS:
            out += self._walk(self.held)
            self._note(self.held)
            self.held = ""
        return out

    def _note(self, walked: str) -> None:
        """What a half walked stretch can go on with: after letters no SPACE, and after a single character nothing."""
        if walked:
            self.open = self.v.rest[0 if walked[-1] == SPACE else 1]

    def _stretch(self, stretch: str) -> list[int]:
        ids = self._walk(stretch) + self._close()
        # only walked from a closed window to a closed one, so the ids are the stretch's own
        if len(stretch) <= REMEMBERED_CHARS and len(self.memory) < REMEMBERED:  # frequent ones come early
            self.memory[stretch] = ids
        return ids

    def _close(self) -> list[int]:
        """At a certain boundary all paths meet."""
        self.alive, self.open = [], None
        return self._commit()

    def _walk(self, chars: str) -> list[int]:
        v, out = self.v, []
        best, back = self.best, self.back
        for c in chars:
            at = self.base + len(best) - 1  # every boundary is reachable, at worst by an unknown character
            alive, top, came = [], None, None
            for start, node in [*self.alive, (at, v.trie)]:
                node = node.get(c)
                if node is None:
                    continue
                alive.append((start, node))
                i = node.get("")
                if i is not None:
                    s = best[start - self.base] + v.score[i]
                    if top is None or s > top:
                        top, came = s, (start, i)
            # as in the lattice, a character is unknown only where it is no piece by itself
            if "" not in v.trie.get(c, ()):
                s = best[-1] + v.unknown
                if top is None or s > top:
                    top, came = s, (at, c)
            best.append(top)
            back.append(came)
            self.alive = alive
            if len(best) > self.look:
                out += self._commit()
                best, back = self.best, self.back
                self.look = max(4 * v.longest, 2 * len(best))
        return out

    def _ids(self, end: int) -> list[int]:
        parts = []
        while end > self.base:
            end, what = self.back[end - self.base]
            parts.append(what)
        out = []
        for what in reversed(parts):
            if isinstance(what, str):
                out += self.v.bytes_of(SPACE if what == self.literal else what)
            else:
                out.append(what)
        return out

    def _commit(self) -> list[int]:
        """Follows the surviving paths back, always from the last boundary, until they are one."""
        here = self.base + len(self.best) - 1
        open_ends = {here, *(start for start, _ in self.alive)}
        while len(open_ends) > 1:
            last = max(open_ends)
            open_ends.remove(last)
            open_ends.add(self.back[last - self.base][0])
        meet = open_ends.pop()
        out = self._ids(meet)
        self.commits += bool(out)
        gone = meet - self.base
        shift = self.best[gone]  # sums start anew, so they stay small in texts of any length
        self.best = [b - shift for b in self.best[gone:]]
        self.back = [None, *self.back[gone + 1:]]
        self.base = meet
        return out

    def finish(self) -> list[int]:
        out = self._walk(self.held)
        out += self._ids(self.base + len(self.best) - 1)
        self._start()
        return out


class PieceEncoder:
    """Texts to ids as little-endian unsigned 32-bit bytes, and back."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.memory: dict[str, list[int]] = {}

    def search(self, text: str) -> tuple[StreamingViterbi, str]:
        """A search for a text, and the text as it reads it: one SPACE before, and SPACE for each space."""
        if SPACE not in text and LITERAL not in text:
            return StreamingViterbi(self.v, LITERAL, self.memory), SPACE + text.replace(" ", SPACE)
        free = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in text and c not in self.v.trie)
        return StreamingViterbi(self.v, free), SPACE + text.replace(SPACE, free).replace(" ", SPACE)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        search, marked = self.search(text)
        parts = []
        for i in range(0, len(marked), SLICE_CHARS):
            parts.append(np.array(search.feed(marked[i:i + SLICE_CHARS]), dtype="<u4").tobytes())
        parts.append(np.array(search.finish(), dtype="<u4").tobytes())
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The exact text of encoded ids. Of others, bytes that are no UTF-8 are replaced."""
        return b"".join(map(self.v.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")[1:]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: key, n_ids, ids_crc32, decoded_sha256 (of the UTF-8 text that the ids decode to) and ids.

    A null text is empty; an empty text has no ids and decodes to itself. Every text decodes exactly. Repeated
    rows and null keys stay rows of their own. An empty table gives no rows. Other columns of `docs` are left out.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(model)
        for pdf in slices(batches):
            ids = [e.encode(t or "") for t in pdf["text"]]
            made = pd.DataFrame({
                "id": pdf["id"].to_numpy(), "n_ids": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids],
                "decoded_sha256": [hashlib.sha256(e.decode(x).encode()).hexdigest() for x in ids],
            })
            if with_ids:
                made["ids"] = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
            yield made

    schema = f"id {kind}, n_ids long, ids_crc32 long, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(run, schema).withColumnRenamed("id", key)


def decode_documents(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text. Null ids give a null text."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(model)
        for pdf in slices(batches):
            texts = [None if x is None else e.decode(np.asarray(x, "<u4").tobytes()) for x in pdf["ids"]]
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "text": texts})

    return encoded.select(F.col(key).alias("id"), F.col(ids).alias("ids")).mapInPandas(run, f"id {kind}, text string").withColumnRenamed("id", key)


def op4_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
