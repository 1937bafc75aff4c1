"""Operator 5, SentencePiece encoding and decoding by streaming Viterbi.

Texts are streams of characters, and many streams advance together, one character a
step.  A stream keeps only its open starts (those from which a piece may still be
growing, never more than the longest piece has characters), each with its trie node
and score, and a window of backpointers.  When the backpointer paths of all open
starts meet in one boundary, everything before it is final: its ids are committed and
leave the window, so memory is bounded by the window, not by the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temblor.llm.common import small_batches, text_runs

MARK = "▁"
MARK_CODE, BLANK_CODE = ord(MARK), ord(" ")
OWN_MARK = 0x110000  # stands for a mark that the text itself has, beyond all characters

#: Scores are whole numbers of 2**-20, so sums are exact and ties don't depend on the order of addition.
UNIT = 1 << 20
NONE = -(1 << 62)


class Trie:
    """The pieces' trie as arrays: node 0 is the root, steps by character code."""

    def __init__(self, pieces: dict[str, tuple[int, int]]):
        chars = sorted({c for p in pieces for c in p})
        code = {c: i for i, c in enumerate(chars)}
        self.unknown = len(chars)
        self.codes = np.full(OWN_MARK + 1, len(chars), np.int32)  # of each character; ``unknown`` for those that no piece has
        self.codes[[ord(c) for c in chars]] = np.arange(len(chars))
        nodes: dict[tuple[int, int], int] = {}
        ids, scores, own = [-1], [0], {}
        for piece, (i, s) in pieces.items():
            node = 0
            for c in piece:
                key = (node, code[c])
                if key not in nodes:
                    nodes[key] = len(ids)
                    ids.append(-1)
                    scores.append(0)
                node = nodes[key]
            ids[node], scores[node] = i, s
            own[piece] = node
        self.ids = np.array(ids, np.int32)
        self.scores = np.array(scores, np.int64)
        self.longest = max(map(len, pieces), default=1)
        parents = sorted({node for node, _ in nodes})
        self.inner = np.full(len(ids), -1, np.int32)
        self.inner[parents] = np.arange(len(parents))
        # Steps by the codes that most nodes have are looked up in a table, the others by search.
        uses = np.bincount([c for _, c in nodes], minlength=self.unknown + 1)
        common = np.argsort(-uses, kind="stable")[:127]
        self.column = np.full(self.unknown + 1, 127, np.int16)
        self.column[common] = np.arange(len(common))
        self.column[self.unknown] = 127
        self.table = np.full((len(parents), 128), -1, np.int32)
        rare = []
        for (node, c), to in nodes.items():
            if self.column[c] < 127:
                self.table[self.inner[node], self.column[c]] = to
            else:
                rare.append((node * (self.unknown + 1) + c, to))
        rare.sort()
        self.keys = np.array([k for k, _ in rare], np.int64)
        self.to = np.array([to for _, to in rare], np.int32)
        self.alone = np.zeros(self.unknown + 1, bool)  # characters that are a piece
        for c, i in code.items():
            self.alone[i] = c in own

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Child of each node that has children by a code, -1 if there is none."""
        column = self.column[code]
        out = self.table[self.inner[node], column]
        odd = np.flatnonzero(column == 127)
        if len(odd) and len(self.keys):
            key = node[odd] * np.int64(self.unknown + 1) + code[odd]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[odd] = np.where(self.keys[at] == key, self.to[at], -1)
        return out


@dataclass
class Vocabulary:
    """Pieces with scores, ids by place, and the 256 byte pieces that spell what no piece covers."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    specials: frozenset[int] = frozenset()
    trie: Trie = field(init=False)
    byte_score: int = field(init=False)
    cut: bool = field(init=False)

    def __post_init__(self):
        skip = self.specials | set(self.byte_ids)
        units = {p: (i, round(self.scores[i] * UNIT)) for i, p in enumerate(self.pieces) if i not in skip and p}
        self.byte_score = min((s for _, s in units.values()), default=0) - 10 * UNIT
        # Without a piece that has a mark behind another character, every path has a boundary before such a mark.
        self.cut = not any(re.search(f"[^{MARK}]{MARK}", p) for p in units)
        self.trie = Trie(units)


def read_vocabulary(path: str, scores: str = "file") -> Vocabulary:
    """Vocabulary of a SentencePiece model file.

    ``scores='file'`` takes the scores as they stand; ``'zipf'`` takes the logarithm
    of 1/(rank + 1), for files whose scores are only ranks.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    pieces = [m.id_to_piece(i) for i in range(n)]
    bytes_ = sorted((int(pieces[i][3:5], 16), i) for i in range(n) if m.is_byte(i))
    special = frozenset(i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
    taken = special | {i for _, i in bytes_}
    values, rank = [], 0
    for i in range(n):
        values.append(m.get_score(i) if scores == "file" else -math.log(rank + 1.0))
        rank += i not in taken
    return Vocabulary(pieces, values, [i for _, i in bytes_], special)


def byte_length(cp: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each character."""
    return 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + ((cp > 0xFFFF) & (cp != OWN_MARK))


class Streams:
    """Viterbi over many streams of characters at once.

    ``first`` and ``size`` tell where each stream lies in ``cp``.  ``run`` returns the
    ids of all streams, in their order, and how many each has; the ids of a spelled
    character are ``-1 - character`` until :func:`spelled_out`.
    """

    def __init__(self, v: Vocabulary, cp: np.ndarray, first: np.ndarray, size: np.ndarray, stride: int = 64):
        self.v, self.cp = v, cp
        self.order = np.argsort(-size, kind="stable")  # longest first, so that the running ones are a prefix
        self.first, self.size = first[self.order], size[self.order]
        self.window = 2 * stride
        n = len(size)
        self.back = np.zeros((self.window, n), np.int32)  # characters of the last piece before a boundary
        self.what = np.zeros((self.window, n), np.int32)
        self.fixed = np.zeros(n, np.int64)  # ids before this boundary are committed
        self.meet = np.zeros(n, np.int64)  # a boundary in which all paths meet
        self.out: list[tuple[np.ndarray, np.ndarray]] = []

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        t, cp, first, size = self.v.trie, self.cp, self.first, self.size
        code = t.codes[cp]
        n = len(size)
        # Running streams at each step; the open starts of all of them, oldest first.
        running = n - np.searchsorted(size[::-1], np.arange(size[0] if n else 0), "right")
        score = np.zeros(n, np.int64)
        node, lane, since, base = np.zeros(n, np.int32), np.arange(n, dtype=np.int32), np.zeros(n, np.int32), score
        for at, m in enumerate(running):
            if m < len(score):
                self.meet[m : len(score)] = size[m : len(score)]  # ended streams
                on = lane < m
                node, lane, since, base, score = node[on], lane[on], since[on], base[on], score[:m]
            here = first[:m] + at
            c = code[here]
            node = t.step(node, c[lane])
            ok = np.flatnonzero(node >= 0)
            node, lane, since, base = node[ok], lane[ok], since[ok], base[ok]
            piece = t.ids[node]
            hit = np.flatnonzero(piece >= 0)
            into, total = lane[hit], base[hit] + t.scores[node[hit]]
            best = np.full(m, NONE)
            np.maximum.at(best, into, total)
            # Of equal scores the longest piece counts: the earliest start is assigned last.
            won = hit[total == best[into]][::-1]
            row = at % self.window
            back, what = self.back[row], self.what[row]
            back[lane[won]] = at + 1 - since[won]
            what[lane[won]] = piece[won]
            spelled = np.flatnonzero(~t.alone[c])
            if len(spelled):
                char = cp[here[spelled]]
                s = score[spelled] + byte_length(char) * self.v.byte_score
                better = s > best[spelled]
                spelled, char = spelled[better], char[better]
                best[spelled], back[spelled], what[spelled] = s[better], 1, -1 - char.astype(np.int64)
            score = best
            grows = np.flatnonzero(t.inner[node] >= 0)
            node, lane, since, base = node[grows], lane[grows], since[grows], base[grows]
            node = np.concatenate([node, np.zeros(m, np.int32)])
            lane = np.concatenate([lane, np.arange(m, dtype=np.int32)])
            since = np.concatenate([since, np.full(m, at + 1, np.int32)])
            base = np.concatenate([base, score])
            if (at + 1) % (self.window // 2) == 0:
                self._find_meetings(lane, since, at + 1)
                self._commit()
                if (at + 1 - self.fixed[:m]).max() > self.window // 2:
                    self._widen(at + 1, int(m))
        self.meet[: len(score)] = size[: len(score)]
        self._commit()
        own = np.concatenate([x for x, _ in self.out]) if self.out else np.zeros(0, np.int64)
        ids = np.concatenate([x for _, x in self.out]) if self.out else np.zeros(0, np.int32)
        own = self.order[own]
        return ids[np.argsort(own, kind="stable")], np.bincount(own, minlength=n)

    def _find_meetings(self, lane: np.ndarray, since: np.ndarray, at: int) -> None:
        """Follow the paths of all open starts back until those of a stream meet in one boundary."""
        place = since.copy()
        lowest = np.full(int(lane[-1]) + 1, at, np.int32)  # every running stream has its newest start, in order, at the end
        np.minimum.at(lowest, lane, place)
        far = np.flatnonzero(place > lowest[lane])
        while len(far):
            place[far] -= self.back[(place[far] - 1) % self.window, lane[far]]
            np.minimum.at(lowest, lane[far], place[far])
            far = np.flatnonzero(place > lowest[lane])
        self.meet[: len(lowest)] = lowest

    def _commit(self) -> None:
        """Emit the ids between what is committed and where all paths meet, following the backpointers."""
        lanes = np.flatnonzero(self.meet > self.fixed)
        at, steps = self.meet[lanes], []
        while len(lanes):
            row = (at - 1) % self.window
            steps.append((lanes, self.what[row, lanes]))
            at = at - self.back[row, lanes]
            on = at > self.fixed[lanes]
            lanes, at = lanes[on], at[on]
        self.out.extend(reversed(steps))
        self.fixed[:] = self.meet

    def _widen(self, at: int, running: int) -> None:
        """Twice the window for the running streams, as the paths of one don't meet in it."""
        rows = np.arange(at - self.window, at)
        for name in ("back", "what"):
            old = getattr(self, name)
            new = np.zeros((2 * self.window, running), old.dtype)
            new[rows % len(new)] = old[rows % self.window, :running]
            setattr(self, name, new)
        self.window *= 2


def spelled_out(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace characters to be spelled by their byte pieces, and count these."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, counts
    cp = -1 - ids[odd].astype(np.int64)
    cp[cp == OWN_MARK] = MARK_CODE
    length = np.ones(len(ids), np.int64)
    length[odd] = byte_length(cp)
    letters = np.frombuffer(cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.repeat(ids, length)
    out[out < 0] = np.array(v.byte_ids, np.int32)[letters]
    ends = np.cumsum(counts)
    before = np.concatenate([[0], np.cumsum(length)])
    return out, before[ends] - before[ends - counts]


LANE = 512


def encode_run(v: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts, one after the other, and how many each has; none for null and empty texts.

    A mark is put before a text and blanks become marks.  A mark that stands in the
    text itself is spelled in bytes, so decoding gives the text back exactly.  Where
    the vocabulary has no piece across the beginning of a word, all paths meet there,
    and a long text is dealt into several streams at such places.
    """
    raw = "".join([f" {t}" for t in texts if t]).encode("utf-32-le", "surrogatepass")
    cp = np.frombuffer(raw, np.uint32).copy()
    own, blank = cp == MARK_CODE, cp == BLANK_CODE
    cp[blank], cp[own] = MARK_CODE, OWN_MARK
    size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    start = np.cumsum(size) - size
    first = start[size > 0]
    if v.cut and len(cp):
        begins = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        n = size // LANE
        grid = np.repeat(start, n) + LANE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
        at = np.searchsorted(begins, grid)
        first = np.union1d(first, begins[at[at < len(begins)]])
    lanes = np.diff(np.append(first, len(cp)))
    ids, counts = spelled_out(v, *Streams(v, cp, first, lanes).run())
    text = np.searchsorted(start, first, "right") - 1
    return ids, np.bincount(text, counts, len(texts)).astype(np.int64) if len(first) else np.zeros(len(texts), np.int64)


def encode(v: Vocabulary, text: str | None) -> list[int]:
    """Ids of a text as a list."""
    return encode_run(v, [text])[0].tolist()


def spellings(v: Vocabulary) -> list[bytes]:
    """What each id stands for in a decoded text."""
    table = [p.replace(MARK, " ").encode("utf-8", "surrogatepass") for p in v.pieces]
    for b, i in enumerate(v.byte_ids):
        table[i] = bytes([b])
    for i in v.specials:
        table[i] = b""
    return table


def decode(table: list[bytes], ids) -> str:
    """The text of a list of ids; the mark put before it is taken off."""
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode_column(docs: DataFrame, text: Column, vocab: Vocabulary) -> Column:
    """Column ``array<int>`` of the ids of a text column; null and empty texts have an empty list."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # as large as the vocabulary

    @F.arrow_udf("array<int>")
    def encoded(column: pa.Array) -> pa.Array:
        got = [encode_run(shared.value, texts) for _, texts in text_runs(column)]
        counts = np.concatenate([np.zeros(1, np.int64), *(c for _, c in got)])
        flat = np.concatenate([np.zeros(0, np.int32), *(i for i, _ in got)])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(flat, pa.int32()))

    return encoded(text)


def decode_column(docs: DataFrame, ids: Column, vocab: Vocabulary) -> Column:
    """Column ``string`` of the texts that lists of ids stand for; null for null, empty for none."""
    shared = docs.sparkSession.sparkContext.broadcast(spellings(vocab))

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        table = shared.value
        offsets = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        return pa.array([decode(table, flat[offsets[i] : offsets[i + 1]].tolist()) if valid[i] else None for i in range(len(column))], pa.string())

    return decoded(ids)


def checked_column(docs: DataFrame, text: Column, vocab: Vocabulary) -> Column:
    """``struct<n, sha256, same>``: number of ids of a text, digest of the ids as little-endian
    32-bit numbers, and whether they decode to the text (null counts as empty).  The ids
    themselves stay in the task."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab, spellings(vocab)))

    @F.arrow_udf("struct<n:bigint,sha256:string,same:boolean>")
    def checked(column: pa.Array) -> pa.Array:
        v, table = shared.value
        sizes, shas, same = [], [], []
        for _, texts in text_runs(column):
            ids, counts = encode_run(v, texts)
            ids = ids.astype("<i4")
            for text, n, end in zip(texts, counts.tolist(), np.cumsum(counts).tolist(), strict=True):
                own = ids[end - n : end]
                sizes.append(n)
                shas.append(hashlib.sha256(own.tobytes()).hexdigest())
                same.append(decode(table, own.tolist()) == (text or ""))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(same, pa.bool_())], ["n", "sha256", "same"])

    return checked(text)


def encode_texts(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` for every whole text; null and empty texts have an empty list.

    One row per input row, repeated and null ids included; other columns play no part.
    """
    return docs.select(F.col(id_col).alias("doc_id"), encode_column(docs, F.col(text_col), vocab).alias("ids"))


def decode_texts(encoded: DataFrame, vocab: Vocabulary, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, text`` for lists of ids, the inverse of :func:`encode_texts`."""
    return encoded.select(F.col(id_col).alias("doc_id"), decode_column(encoded, F.col(ids_col), vocab).alias("text"))
