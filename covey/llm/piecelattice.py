"""The piece lattice of a SentencePiece model, as a max-plus system.

A text's encoding is the best path through the lattice of its pieces.  Of a unigram model a path scores the sum of its
pieces' scores.  Of a BPE model the encoding by merges is the one path whose neighbours are compatible: a pair of pieces
is compatible if encoding their joined characters gives that pair back.  (Merging the whole text crosses the border of
two final pieces never, merging the pair alone would cross it at the same merge.)  There a path scores 0 over compatible
neighbours and minus infinity over others.  The max-plus product of the pieces' transitions over a range of characters
gives the best score from each state before the range to each state after it.

A state at a position is a piece that ends there or reaches over it.  Pieces don't hold a space mark behind another
character, so there is a border wherever another character meets a space mark, and no path crosses it with a piece.
Between two such borders there is a single state on either side: the transfer matrix of a word is one number, and its
best path is remembered by the word's characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
NEVER = -np.inf
UNIGRAM, BPE = 1, 2  # fixed values: model types of the file format
UNKNOWN_COST = 10.0  # fixed value: how far an unknown character scores below the least piece


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out, at, shift = out | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            return out, at


def fields(data: bytes):
    """(number, value) of a protocol buffer message; submessages and strings as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def model_type(model: bytes) -> int:
    trainer = next((v for n, v in fields(model) if n == 2), b"")
    return next((v for n, v in fields(trainer) if n == 3), UNIGRAM)


class Pieces:
    """One model with what encoding by chunks needs; ``of`` keeps one for each model and process."""

    made: dict[bytes, Pieces] = {}
    MOST_WORDS, MOST_WALKED, MOST_PAIRS = 60_000, 60_000, 120_000  # remembered by a worker: some 50 MB

    def __init__(self, model: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.kind = model_type(model)
        size = len(self.lib)
        self.piece = [self.lib.id_to_piece(i) for i in range(size)]
        special = [self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i) for i in range(size)]
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i]}
        self.score = {p: self.lib.get_score(i) for p, i in self.id.items()}
        self.bytes = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.id))
        self.begins = {p[:n] for p in self.id for n in range(1, len(p) + 1)}
        self.unknown = min(self.score.values()) - UNKNOWN_COST
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.walked: dict[str, tuple[bytes, float]] = {}
        self.mark = np.array([self.id[MARK]], np.int32).tobytes() if MARK in self.id else b""
        surface = [b"" if s else p.replace(MARK, " ").encode() for p, s in zip(self.piece, special)]
        for b, i in enumerate(self.bytes):
            surface[i] = bytes([b])
        self.by_library = np.array([s and not self.lib.is_byte(i) for i, s in enumerate(special)])
        self.surface = pa.array([*surface, *(s.removeprefix(b" ") for s in surface)], pa.binary())  # then as a text's first
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("the model neither merges pieces nor scores them")
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("the model has pieces with a space mark inside")
        if self.lib.piece_to_id("<0x00>") == self.lib.unk_id():
            raise ValueError("the model has no pieces for bytes")
        probe = "a  b\n c"
        if self.lib.encode(probe) != np.frombuffer(self.word(MARK + probe.replace(" ", MARK))[0], np.int32).tolist():
            raise ValueError("the model doesn't encode by its pieces without normalisation")

    @classmethod
    def of(cls, model: bytes) -> Pieces:
        key = hashlib.sha1(model).digest()
        if key not in cls.made:
            cls.made[key] = cls(model)
        return cls.made[key]

    def forget(self) -> None:
        """Drops what walks have remembered, at the end of a task over giant documents."""
        self.walked.clear()
        self.pairs.clear()

    # --- merges ---------------------------------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Pieces and single characters that merging by best score, leftmost first, leaves."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def ids_of(self, part: str) -> list[int]:
        found = self.id.get(part)
        return [found] if found is not None else [self.bytes[b] for b in part.encode("utf-8", "surrogatepass")]

    def compatible(self, a: str, b: str) -> bool:
        if self.kind == UNIGRAM:
            return True
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > self.MOST_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return found

    # --- whole texts ------------------------------------------------------------------------------------------------

    def encode(self, text: str) -> bytes:
        """Piece ids as int32 bytes, from words that the library has encoded before where it has."""
        if not text:
            return b""
        out, spaces, words, lib = [], "", self.words, self.lib
        for w in text.split(" "):
            if not w:
                spaces += " "
                continue
            if spaces:
                w, spaces = spaces + w, ""
            ids = words.get(w)
            if ids is None:
                ids = np.array(lib.encode(w), np.int32).tobytes()
                if len(words) < self.MOST_WORDS and len(w) < 64:
                    words[w] = ids
            out.append(ids)
        if spaces:
            out.append(np.array(lib.encode(spaces[1:]), np.int32).tobytes() if len(spaces) > 1 else self.mark)
        return b"".join(out)

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The texts of lists of ids: joined pieces, by the library where a list has controls or bytes of no character."""
        lists = pc.fill_null(lists, [])
        ids, length = np.array(lists.flatten()), np.asarray(lists.value_lengths())
        end = np.cumsum(length)
        begin = end - length
        odd = np.r_[0, np.cumsum(self.by_library[ids])]
        apart = set(np.flatnonzero(odd[end] > odd[begin]).tolist())
        first = ids.copy()
        first[begin[length > 0]] += len(self.piece)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, end].astype(np.int32)), self.surface.take(pa.array(first))), b"")
        try:
            texts = texts.cast(pa.string())
            if not apart:
                return texts
            out = texts.to_pylist()
        except pa.ArrowInvalid:
            apart, out = set(range(len(length))), [None] * len(length)
        for k in apart:
            out[k] = self.lib.decode(ids[begin[k] : end[k]].tolist())
        return pa.array(out, pa.string())

    # --- the lattice ------------------------------------------------------------------------------------------------

    def starting(self, text: str, at: int) -> list[str]:
        """Parts that can stand at ``at``: pieces (of merges, those that merging leaves whole), and the single character."""
        out = [text[at]]
        id_of, begins, whole = self.id, self.begins, self.pairs
        for end in range(at + 2, min(at + self.longest, len(text)) + 1):
            p = text[at:end]
            if p not in begins:
                break
            if p in id_of:
                good = self.kind == UNIGRAM or whole.get((p, ""))
                if good is None:
                    good = whole[p, ""] = self.merge(p) == [p]
                if good:
                    out.append(p)
        return out

    def gain(self, part: str) -> float:
        return 0.0 if self.kind == BPE else self.score.get(part, self.unknown)

    def word(self, text: str) -> tuple[bytes, float]:
        """Ids and score of the best path through a text with a border on either side."""
        found = self.walked.get(text)
        if found is not None:
            return found
        n = len(text)
        parts, score = self._only_path(text) if self.kind == BPE else self._best_path(text)
        found = (np.array([i for x in parts for i in self.ids_of(x)], np.int32).tobytes(), score)
        if len(self.walked) < self.MOST_WALKED and n < 64:
            self.walked[text] = found
        return found

    def _best_path(self, text: str) -> tuple[list[str], float]:
        ending: list[dict] = [{"": (0.0, "")}, *({} for _ in text)]  # at a position: part that ends there -> (score, part before)
        for pos in range(len(text)):
            before = max(ending[pos], key=lambda p: ending[pos][p][0], default=None)
            if before is not None:
                score = ending[pos][before][0]
                for part in self.starting(text, pos):
                    ending[pos + len(part)][part] = (score + self.gain(part), before)
        at, out = len(text), []
        part = max(ending[at], key=lambda p: ending[at][p][0])
        total = ending[at][part][0]
        while at:
            out.append(part)
            at, part = at - len(part), ending[at][part][1]
        return out[::-1], total

    def _only_path(self, text: str) -> tuple[list[str], float]:
        """Of merges all paths but one score minus infinity: it is found by trying long parts first, each place and part once."""
        n, pos, pairs = len(text), 0, self.pairs
        path, tried, ways = [""], set(), [iter(self.starting(text, 0)[::-1])]
        while pos < n:
            before = path[-1]
            for part in ways[-1]:
                if (pos, part) in tried:
                    continue
                if before:
                    fits = pairs.get((before, part))
                    if not (self.compatible(before, part) if fits is None else fits):
                        continue
                tried.add((pos, part))
                path.append(part)
                pos += len(part)
                ways.append(iter(self.starting(text, pos)[::-1] if pos < n else ()))
                break
            else:
                ways.pop()
                pos -= len(path.pop())
                if not ways:
                    raise ValueError("no path through the pieces of a word")
        return path[1:], 0.0

    def words_between(self, text: str) -> tuple[bytes, float]:
        """Ids and score of a text with borders on either side, word by word."""
        out, total, spaces = [], 0.0, ""
        for w in text.split(MARK)[1:]:  # a text between borders begins with a mark
            if not w:
                spaces += MARK
                continue
            ids, score = self.word(spaces + MARK + w)
            spaces = ""
            out.append(ids)
            total += score
        if spaces:
            raise ValueError("a text between borders doesn't end with a mark")
        return b"".join(out), total

    def states(self, text: str, at: int) -> list[tuple[int, str]]:
        """(characters behind ``at``, part) of every part of ``text`` that starts before ``at`` and ends at or behind it."""
        return [(b + len(p) - at, p) for b in range(max(0, at - self.longest), at) for p in self.starting(text, b) if b + len(p) >= at]

    def borders(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and last position in [lo, hi] at which another character meets a space mark."""
        at = text.find(MARK, max(lo, 1))
        while at != -1 and at <= hi and text[at - 1] == MARK:
            at = text.find(MARK, at + 1)
        if at == -1 or at > hi:
            return None
        last = hi
        while last > at and not (last < len(text) and text[last] == MARK and text[last - 1] != MARK):
            last = text.rfind(MARK, at, last)
        return at, last


class Walk:
    """Best scores from the states at ``lo`` to every part up to ``hi``, and the way back."""

    def __init__(self, pieces: Pieces, text: str, lo: int, hi: int, before: list[tuple[int, str]]):
        self.pieces, self.text, self.lo, self.hi = pieces, text, lo, hi
        n = len(before)
        # at[position]: part ending there -> (scores by state before, its start, part ahead of it by state before)
        self.at: dict[int, dict[tuple[int, str], tuple]] = {}
        for k, (over, part) in enumerate(before):
            row = np.full(n, NEVER)
            row[k] = 0.0
            self.at.setdefault(lo + over, {})[lo + over - len(part), part] = (row, None)
        if not before:  # the text begins here
            self.at[lo] = {(lo, ""): (np.zeros(1), None)}
        for pos in range(lo, hi):
            ending = self.at.get(pos)
            if not ending or not any(np.isfinite(v[0]).any() for v in ending.values()):
                continue
            for part in pieces.starting(text, pos):
                scores, back = None, None
                for key, (row, _) in ending.items():
                    if key[1] == "" or pieces.compatible(key[1], part):
                        if scores is None:
                            scores, back = row.copy(), [key if np.isfinite(x) else None for x in row]
                        else:
                            better = row > scores
                            scores = np.where(better, row, scores)
                            back = [key if b else old for b, old in zip(better, back)]
                if scores is not None:
                    self.at.setdefault(pos + len(part), {})[pos, part] = (scores + pieces.gain(part), back)

    def matrix(self, after: list[tuple[int, str]]) -> np.ndarray:
        """Max-plus transfer matrix, states before by states after (those at ``hi``)."""
        n = len(next(iter(self.at[min(self.at)].values()))[0])
        out = np.full((n, len(after)), NEVER)
        for j, (over, part) in enumerate(after):
            found = self.at.get(self.hi + over, {}).get((self.hi + over - len(part), part))
            if found is not None:
                out[:, j] = found[0]
        return out

    def path(self, before: int, after: tuple[int, str]) -> list[str]:
        """Parts behind the state before, up to and with the state after."""
        end = self.hi + after[0]
        key = (end - len(after[1]), after[1])
        out = []
        while True:
            back = self.at[end][key][1]
            if back is None:
                return out[::-1]
            if key[1]:
                out.append(key[1])
            end, key = key[0], back[before]


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1) if a.size and b.size else np.full((a.shape[0], b.shape[1]), NEVER)


class Chunk:
    """Characters [lo, hi) of a text of which ``text`` holds them and the context around; first and last: of the text.

    The chunk owns the parts that start in it, but for those of the last state before: its parts begin where that
    state ends, and the state after it ends them.
    """

    def __init__(self, pieces: Pieces, text: str, lo: int, hi: int, first: bool, last: bool):
        self.pieces, self.text, self.lo, self.hi, self.first, self.last = pieces, text, lo, hi, first, last
        self.before = [] if first else pieces.states(text, lo)
        self.after = [s for s in pieces.states(text, hi) if not last or s[0] == 0]
        # behind every part that reaches over lo, the first border; ahead of every part that reaches over hi, the last
        self.middle = None if hi - lo <= 4 * pieces.longest else pieces.borders(text, lo + pieces.longest, hi - pieces.longest)
        if self.middle and self.middle[0] >= self.middle[1]:
            self.middle = None

    def _ends(self, at: int) -> list[tuple[int, str]]:
        return [s for s in self.pieces.states(self.text, at) if s[0] == 0]

    def _walks(self) -> list:
        if not self.middle:
            return [Walk(self.pieces, self.text, self.lo, self.hi, self.before)]
        a, b = self.middle
        return [Walk(self.pieces, self.text, self.lo, a, self.before), Walk(self.pieces, self.text, b, self.hi, [])]

    def matrix(self) -> np.ndarray:
        """The product of the transfers up to the first border, of the words from there to the last, and behind it."""
        walks = self._walks()
        if not self.middle:
            return walks[0].matrix(self.after)
        a, b = self.middle
        reach = walks[0].matrix(self._ends(a))
        reach = reach.max(axis=1, keepdims=True) if reach.size else np.full((len(reach), 1), NEVER)
        between = 0.0 if self.pieces.kind == BPE else self.pieces.words_between(self.text[a:b])[1]  # paths of merges score 0
        return multiply(reach + between, walks[1].matrix(self.after))

    def ids(self, before: int, after: int) -> bytes:
        """Piece ids of the chunk's parts for the chosen states."""
        walks, p = self._walks(), self.pieces
        to_ids = lambda parts: np.array([i for x in parts for i in p.ids_of(x)], np.int32).tobytes()
        if not self.middle:
            return to_ids(walks[0].path(before, self.after[after]))
        a, b = self.middle
        ends = self._ends(a)
        best = int(np.argmax(walks[0].matrix(ends)[before]))
        return to_ids(walks[0].path(before, ends[best])) + p.words_between(self.text[a:b])[0] + to_ids(walks[1].path(0, self.after[after]))
