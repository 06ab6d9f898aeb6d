"""SentencePiece encoding and decoding of merge-type vocabularies, held against the library."""

from __future__ import annotations

import codecs
import hashlib
import re
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from listings_spark.llm.common import text_slices

SPACE = "▁"  # stands for a space in pieces
CUT = "\n"  # stands alone in vocabularies whose texts are cut
CACHE = 1 << 18  # chunks remembered in each of two generations of a worker's memory
SHORT = 48  # symbols of a chunk that is merged together with others of its length
TOGETHER = 256  # chunks that the library is asked for in one text
NEVER = 1 << 30  # rank of pairs that form no piece
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def _replace_bytes(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd" * (error.end - error.start), error.end


codecs.register_error("each-byte", _replace_bytes)


def merged(chunk: str, ranks: dict[str, int]) -> list[str]:
    """The pieces of a chunk: adjacent symbols join by falling score, leftmost first.

    `ranks` has the places of pieces by falling score. The agenda is a heap of (rank, place) of all
    adjacent pairs that form a piece; an entry whose pair has changed since is skipped. A merge
    adds at most two pairs, so n symbols take n log n steps.
    """
    symbols = list(chunk)
    rank, last = ranks.get, len(symbols)
    before, after = list(range(-1, last - 1)), list(range(1, last + 1))
    now = [rank(a + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)] + [NEVER]
    agenda = [r * last + left for left, r in enumerate(now) if r != NEVER]
    heapify(agenda)
    while agenda:
        best, left = divmod(heappop(agenda), last)
        if now[left] != best:
            continue
        right = after[left]
        pair = symbols[left] + symbols[right]
        symbols[left], symbols[right], now[right] = pair, "", NEVER
        ahead, behind = after[right], before[left]
        after[left], now[left] = ahead, NEVER
        if ahead < last:
            before[ahead] = left
            now[left] = rank(pair + symbols[ahead], NEVER)
            if now[left] != NEVER:
                heappush(agenda, now[left] * last + left)
        if behind >= 0:
            now[behind] = rank(symbols[behind] + pair, NEVER)
            if now[behind] != NEVER:
                heappush(agenda, now[behind] * last + behind)
    return [s for s in symbols if s]


class PairTable:
    """The pairs of pieces that form a piece: their ranks, and the pieces that they form."""

    def __init__(self, ids: dict[str, int], ranks: dict[str, int]):
        rows = sorted(
            (ids[piece[:cut]] << 32 | ids[piece[cut:]], rank, ids[piece])
            for piece, rank in ranks.items()
            for cut in range(1, len(piece))
            if piece[:cut] in ids and piece[cut:] in ids
        )
        pairs = np.array(rows or [(0, NEVER, 0)], dtype=np.int64)
        self.keys, self.ranks, self.forms = pairs.T
        self.single = np.full(0x110000, -1, dtype=np.int64)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece formed) of pairs, NEVER where they form none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER), self.forms[at]

    def merge(self, symbols: np.ndarray) -> list[tuple]:
        """Pieces of many chunks of one length at once: each round takes the top of every agenda.

        A row's agenda is the ranks of its adjacent pairs in place order, so the first least one
        is the leftmost best. Every row that is not done merges once a round, so rows keep one length.
        """
        out: list[tuple] = [()] * len(symbols)
        rows = np.arange(len(symbols))
        rank, form = self.look(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            width, here = symbols.shape[1], np.arange(len(rows))
            at = rank.argmin(axis=1) if width > 1 else np.zeros(len(rows), dtype=int)
            done = rank[here, at] == NEVER if width > 1 else np.ones(len(rows), dtype=bool)
            for row, pieces in zip(rows[done].tolist(), symbols[done].tolist(), strict=True):
                out[row] = tuple(pieces)
            if done.all():
                break
            rows, symbols, rank, form, at = (x[~done] for x in (rows, symbols, rank, form, at))
            here = np.arange(len(rows))
            symbols[here, at] = form[here, at]
            symbols = symbols[np.arange(width) != at[:, None] + 1].reshape(len(rows), width - 1)
            keep = np.arange(width - 1) != at[:, None]
            rank, form = (x[keep].reshape(len(rows), width - 2) for x in (rank, form))
            for first, ok in ((at, at < width - 2), (at - 1, at > 0)):
                row, col = here[ok], first[ok]
                rank[row, col], form[row, col] = self.look(symbols[row, col], symbols[row, col + 1])
        return out


class Pieces:
    """A merge-type vocabulary: encodes by an agenda of pairs, decodes by table.

    Texts are cut where no piece can reach across (before spaces, around characters that only
    stand alone), which changes no merge; the ids of recent chunks are remembered.
    """

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.library.get_piece_size())
        if any(self.library.is_unused(i) for i in ids):
            raise ValueError("vocabularies with unused pieces are not supported")
        names = [self.library.id_to_piece(i) for i in ids]
        self.control = {i for i in ids if self.library.is_control(i)}
        special = self.control | {i for i in ids if self.library.is_unknown(i)}
        self.byte_ids = {
            int(BYTE.fullmatch(names[i])[1], 16): i for i in ids if self.library.is_byte(i)
        }
        self.bytes = set(self.byte_ids.values())
        own = [i for i in ids if i not in special and not self.library.is_byte(i)]
        self.ids = {names[i]: i for i in own}
        joined = [i for i in own if len(names[i]) > 1]
        levels = sorted({self.library.get_score(i) for i in joined}, reverse=True)
        places = {score: rank for rank, score in enumerate(levels)}
        self.ranks = {names[i]: places[self.library.get_score(i)] for i in joined}
        self.unknown, self.end = self.library.unk_id(), self.library.eos_id()
        self.written = [str(i) for i in ids]
        self.parts = [names[i].replace(SPACE, " ").encode() for i in ids]
        for value, i in self.byte_ids.items():
            self.parts[i] = bytes([value])
        for i in special:
            self.parts[i] = b""
        self.parts[self.unknown] = self.library.decode([self.unknown]).encode()
        self.chunks = self._chunks(set(self.ranks))
        self.wrong: set[str] = set()  # chunks whose ids the library does not share
        self.doubtful: list[bool] = []  # of the texts encoded last, those with such a chunk
        self.table = PairTable(self.ids, self.ranks)
        self.recent: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    @staticmethod
    def _chunks(joined: set[str]) -> re.Pattern | None:
        """What to cut a text into, or null where a piece reaches over a space."""
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in joined):
            return None
        joining = "".join(map(re.escape, sorted({c for piece in joined for c in piece} - {SPACE})))
        if not joining or any(CUT in piece for piece in joined):
            return None
        return re.compile(f"{SPACE}*[{joining}]+|{SPACE}+|[^{SPACE}{joining}]")

    def chunk_ids(self, chunk: str) -> list[int]:
        found = []
        for piece in merged(chunk, self.ranks):
            known = self.ids.get(piece)
            if known is not None:
                found.append(known)
            elif self.byte_ids:
                found += [self.byte_ids[b] for b in piece.encode()]
            elif not found or found[-1] != self.unknown:
                found.append(self.unknown)  # neighbours unknown to the vocabulary share an id
        return found

    def learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks: short ones of whole pieces together, by length."""
        if len(self.recent) + len(chunks) > CACHE:
            self.older, self.recent = self.recent, {}
        by_length: dict[int, list[str]] = {}
        for chunk in chunks:
            by_length.setdefault(len(chunk) if len(chunk) <= SHORT else 0, []).append(chunk)
        for length, alike in by_length.items():
            if not length:
                self.recent.update((c, tuple(self.chunk_ids(c))) for c in alike)
                continue
            codes = np.frombuffer("".join(alike).encode("utf-32-le"), dtype=np.uint32)
            symbols = self.table.single[codes].reshape(len(alike), length)
            known = (symbols >= 0).all(axis=1)
            whole = [c for c, k in zip(alike, known.tolist(), strict=True) if k]
            self.recent.update(zip(whole, self.table.merge(symbols[known]), strict=True))
            self.recent.update((c, tuple(self.chunk_ids(c))) for c, k in zip(alike, known.tolist(), strict=True) if not k)

    def check(self, chunks: list[str]) -> None:
        """Hold what was learned against the library, in one text of all chunks between ends.

        Cuts lie where no piece reaches across, so ids of a text agree if those of its chunks do.
        """
        if not self.chunks:
            self.wrong.update(
                c for c in chunks if [*self.recent[c], self.end] != self.encode_by_library(c)
            )
            return
        cut = self.recent[CUT] if CUT in self.recent else tuple(self.chunk_ids(CUT))
        told = self.encode_by_library(f"{SPACE}{CUT}{''.join([c + CUT for c in chunks])}")
        own = [*self.chunk_ids(SPACE), *cut]
        for c in chunks:
            own += self.recent[c]
            own += cut
        if told == [*own, self.end]:
            return
        if len(chunks) == 1:
            self.wrong.update(chunks)
        for half in (chunks[: len(chunks) // 2], chunks[len(chunks) // 2 :]):
            if 0 < len(half) < len(chunks):
                self.check(half)

    def encode_by_library(self, normal: str) -> list[int]:
        """Ids that the library gives a normalised text that begins with the space put before it."""
        return self.library.encode(normal.removeprefix(SPACE).replace(SPACE, " "), add_eos=True)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, with an end id only."""
        normal = [self.library.normalize(t) for t in texts]
        cut = [self.chunks.findall(t) if self.chunks else [t] for t in normal]
        met = {c for chunks in cut for c in chunks}
        new = met.difference(self.recent)
        kept = {c: self.older[c] for c in new if c in self.older}
        learned = list(new.difference(kept))
        if learned:
            self.learn(learned)
            for start in range(0, len(learned), TOGETHER):
                self.check(learned[start : start + TOGETHER])
        self.recent.update(kept)
        out, recent, older = [], self.recent, self.older
        for chunks in cut:
            ids: list[int] = []
            for chunk in chunks:
                ids += recent[chunk] if chunk in recent else older[chunk]
            if not self.byte_ids:
                ids = [x for k, x in enumerate(ids) if x != self.unknown or not k or ids[k - 1] != x]
            out.append([*ids, self.end])
        self.doubtful = [bool(self.wrong) and not self.wrong.isdisjoint(c) for c in cut]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces one after another, less the space put before the first."""
        if ids and ids[-1] == self.end:
            ids = ids[:-1]
        runs: list[list[int]] = [[]]  # control ids write nothing, but end a run of bytes
        if not self.control.isdisjoint(ids):
            for i in ids:
                if i in self.control:
                    runs.append([])
                else:
                    runs[-1].append(i)
        else:
            runs = [ids]
        runs = [r for r in runs if r]
        text = "".join(b"".join([self.parts[i] for i in r]).decode(errors="each-byte") for r in runs)
        first = runs[0][0] if runs else self.unknown
        added = first != self.unknown and first not in self.bytes and text.startswith(" ")
        return text[1:] if added else text


_loaded: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The vocabulary of a model, made once in each worker."""
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model)
    return _loaded[key]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """Token ids of every whole text and the text they decode to, as counts and digests.

    The vocabulary file is read by the driver and sent with the tasks. In every Arrow batch the
    sentencepiece library encodes all chunks of texts that the agenda has merged for the first
    time, and one whole text of each slice of two million characters, which it also decodes; `agrees` tells
    whether ids and decoded text are the same.

    Null text: as empty, which has the end id only. Null and repeated ids: one row per row. Texts
    of any length, also without spaces, take n log n steps. Empty input: no rows. Other columns
    are ignored. Columns: doc_id, n_tokens, ids_sha256 (decimal ids joined by a space),
    decoded_sha256, agrees.
    """
    model = Path(model_file).read_bytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = loaded(model)
        for batch in batches:
            for start, texts in text_slices([t or "" for t in batch.column(1).to_pylist()]):
                counts, ids_sha, decoded_sha, agrees = [], [], [], []
                found = own.encode(texts)
                first = own.library.encode(texts[0], add_eos=True)
                same = found[0] == first and own.decode(found[0]) == own.library.decode(first)
                for ids, doubt in zip(found, own.doubtful, strict=True):
                    decoded = own.decode(ids)
                    counts.append(len(ids))
                    line = " ".join([own.written[i] for i in ids])
                    ids_sha.append(hashlib.sha256(line.encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                    agrees.append(same and not doubt)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(counts, type=pa.int64()),
                     pa.array(ids_sha, type=pa.string()), pa.array(decoded_sha, type=pa.string()),
                     pa.array(agrees, type=pa.bool_())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"
    )
