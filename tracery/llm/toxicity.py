"""Toxicity scores over restored text.

A noisy channel explains disguised words: letters replaced by look-alikes (ASCII signs or letters of other scripts),
spread by spaces or marks, repeated, run together, or split by a space. What may be disguised is a lattice of the
letters, gaps and joints that its characters may stand for, decoded by Viterbi under a character language model that is
counted over all documents, whatever its length. The text as it is read then is scored: by how likely texts with a
word of a lexicon are toxic, and by a logistic model over the evidence of all words, which ranks the others.

Learning: labels are read only for rows whose crc32(id as text) modulo 3 is not 1. The classifier is fitted on at most
``FIT_ROWS`` labelled rows of each class (those of lowest hash, so the choice doesn't depend on the order of rows);
the language model, and the scoring, cover every document whole.

Defined results: a null or empty text has no words, and scores what a text without evidence does; repeated rows
score alike; a null id is not held out and never used for learning; without labels of both classes every score is 0;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.llm.grid import LOWERED, PLAIN, SPACED, U64, Grid, column, mix, runs, string_buffers
from tracery.llm.near_duplicates import near_duplicate_classes
from tracery.llm.tables import id_and_text, id_field, only_kept, written

#: Labelled rows of each class that the classifier is fitted on.
FIT_ROWS = 6_000
#: Rows whose sets of so many words in a row have this Jaccard similarity in percent are copies when learning.
COPY_WIDTH, COPY_PERCENT = 3, 50
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: At least this share of the rows with a feature of the lexicon is toxic.
MIN_SHARE = 0.9
#: Lengths in bytes of the beginnings of words that are features too.
PREFIXES = (4, 5, 6, 7, 8)
#: Words of a row that count for a feature at most, so that no single row makes one.
MOST_A_ROW = 3
#: The first four bytes of words fall into so many buckets, whose shares lean a text to one class or the other.
LEANS = 1 << 12
#: Texts of fewer distinct words count as having so many.
FEW_WORDS = 10
#: The column of the evidence that says how a text leans.
LEANING = 3

# Symbols of the language model: 0 is a boundary or anything else, 1 to 26 are letters, 27 is a byte outside ASCII.
_SIZE = 28
_CODE = np.zeros(256, dtype=np.int32)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = 27

#: What a character may stand for in disguised words.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "#": "h", "*": "aeiou",
}
#: Letters of other scripts that look like ASCII letters.
SCRIPTS = {
    "\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0443": "y", "\u0445": "x", "\u0456": "i", "\u0458": "j", "\u0455": "s",
    "\u0501": "d", "\u04bb": "h", "\u04cf": "l", "\u043c": "m", "\u0442": "t", "\u043a": "k", "\u0432": "b", "\u043d": "h", "\u0261": "g", "\u0131": "i",
    "\u03b1": "a", "\u03bf": "o", "\u03c1": "p", "\u03b9": "i", "\u03bd": "v", "\u03c4": "t", "\u03ba": "k", "\u03c5": "u", "\u03b5": "e", "\u03c7": "x",
}
_MARKS = set(" .,-_*~'\"/\\:;=^")
_LOOK_COST, _WILD_COST, _DROP_COST, _MARK_COST, _REPEAT_COST, _RUN_COST, _JOIN_COST = 1.0, 2.5, 4.0, 0.2, 1.5, 0.05, 3.0
#: Bytes that begin characters outside ASCII which may be look-alikes or have no width.
_FOREIGN_LEAD = np.zeros(256, dtype=bool)
_FOREIGN_LEAD[[0xC2, 0xC4, 0xC9, *range(0xCD, 0xD5), 0xE2, 0xEF, 0xF0]] = True
_NO_WIDTH = dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff"))
_FOREIGN = re.compile("[\u00ad\u0131\u0261\u0370-\u052f\u200b-\u200d\u2060\ufeff\uff01-\uff5e\U0001d400-\U0001d7ff]")
#: A split word has at most so many parts, and at most so many bytes between two of them.
_PARTS, _BETWEEN = 4, 3

_ODD = np.zeros(256, dtype=bool)
_ODD[[ord(c) for c in LOOKS_LIKE]] = True
_ODD[[ord(c) for c in "._-~"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_END, _START = "!*#%&?.,;:|\"')", "\"'(["
_STRANGE = re.compile(r"[a-z][^a-z]+[a-z]|^[^a-z]+[a-z]|[a-z][0-9@$|+!]*[0-9@$|+]$|([a-z])\1\1|(?:([a-z])\2.*?){3}")
#: A word within letters without known boundaries counts if boundaries around it cost no more than this.
_APART_COST = 4.0
#: A word of the lexicon counts as read if it costs no more than this a letter above the best reading.
_LETTER_COST = 1.0
#: What is more than so many times as long as any word of the lexicon isn't read as one.
_OFTEN = 8
#: Letters on both sides that such boundaries are judged with.
_AROUND = 12
_REPEATED = re.compile(r"(.)\1{3,}", re.DOTALL)
_REMEMBERED = 100_000
#: Bytes of text that are scored at once.
_RUN = 1 << 19


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each four symbols follow each other, one row a gram that the task saw."""
    total = np.zeros(_SIZE**4, dtype=np.int64)
    for run in runs(batches):
        offsets, raw = string_buffers(column(run, "text"))
        codes = np.zeros(len(raw) + 3 * len(run) + 3, dtype=np.int32)
        # Three boundaries stand before each text.
        codes[np.arange(len(raw)) + 3 + 3 * np.repeat(np.arange(len(run), dtype=np.int32), np.diff(offsets))] = _CODE[LOWERED[raw]]
        for a in range(0, len(codes) - 3, 1 << 18):
            part = codes[a : a + (1 << 18) + 3]
            total += np.bincount(((part[:-3] * _SIZE + part[1:-2]) * _SIZE + part[2:-1]) * _SIZE + part[3:], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"gram": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})


def code_of(symbol: str) -> int:
    return ord(symbol) - 96 if "a" <= symbol <= "z" else 27 if symbol > "\x7f" else 0


_ANY = "abcdefghijklmnopqrstuvwxyz"


def lattice(seen: str, gaps: bool = False, spaces: bool = False, hidden: str = LOOKS_LIKE["*"]) -> list[list[tuple[str | None, float]]]:
    """What each character may stand for, as (symbol or nothing, cost of the channel); a star for any of ``hidden``.

    A letter is itself, or nothing after the same letter; a look-alike one of its letters; a mark nothing. Long
    repetitions count as three. With ``gaps`` words may be run together: a boundary may follow any character. With
    ``spaces`` a space seen is a boundary, or was put into a word.
    """
    seen, last, arcs = _REPEATED.sub(r"\1\1\1", seen), "", []
    for i, c in enumerate(seen):
        run = (i > 1 and seen[i - 2] == last == c) or (i + 1 < len(seen) and seen[i + 1] == last == c)
        letters = c if "a" <= c <= "z" else hidden if c == "*" else LOOKS_LIKE.get(c, "")
        cost = 0.0 if c == letters else _WILD_COST if len(letters) > 2 else _LOOK_COST
        skip = _MARK_COST if c in _MARKS else _DROP_COST if c != letters else None
        if c == last:
            skip = _RUN_COST if run else _REPEAT_COST
        if spaces and c == " ":
            arcs.append([(" ", 0.0), (None, _JOIN_COST)])
        else:
            here: list[tuple[str | None, float]] = [(letter, cost) for letter in letters]
            if skip is not None:
                here.append((None, skip))
            arcs.append(here or [(c, 0.0)])
        if gaps:
            arcs.append([(None, 0.0), (" ", 0.0)])
        last = c
    return arcs


def folded(text: str) -> str:
    """The text with letters of other scripts that stand among ASCII letters, wide ones and so on, as ASCII letters."""

    def fold(m: re.Match) -> str:
        token = m.group()
        if not _FOREIGN.search(token):
            return token
        plain = "".join(w if len(w := unicodedata.normalize("NFKC", c)) == 1 and w.isascii() else c for c in token.translate(_NO_WIDTH))
        said = "".join(SCRIPTS.get(c.lower(), c) for c in plain)
        return said if re.search("[a-zA-Z]", plain) else plain

    return re.sub(r"\S+", fold, text) if _FOREIGN.search(text) else text


class CharModel:
    """Log probabilities of a symbol after three others, each order smoothed by the next lower one."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape((_SIZE,) * 4).astype(np.float64)
        p = np.full(_SIZE, 1.0 / _SIZE)
        for order in range(1, 5):
            c = n.sum(axis=tuple(range(4 - order))) if order < 4 else n
            kinds = np.maximum((c > 0).sum(axis=-1, keepdims=True), 1)
            p = (c + kinds * p) / (c.sum(axis=-1, keepdims=True) + kinds)
        self.log = np.log(p).reshape(-1).astype(np.float32)

    def decode(self, seen: str, gaps: bool = False, spaces: bool = False) -> str:
        return self.best(seen, gaps, spaces)[1]

    def cost(self, word: str) -> float:
        """What the model asks for a word between boundaries."""
        state, total = 0, 0.0
        for c in f"{word} ":
            state = state * _SIZE + code_of(c)
            total -= float(self.log[state])
            state %= _SIZE**3
        return total

    def cost_as(self, seen: str, word: str, spaces: bool = False) -> float:
        """What it costs to read as a word what is seen, a star as any letter; infinite if there is no such reading."""
        reached = {0: 0.0}  # letters of the word so far
        for arcs in lattice(seen, spaces=spaces, hidden=_ANY):
            new: dict[int, float] = {}
            for n, so_far in reached.items():
                for symbol, cost in arcs:
                    to = n if symbol is None else n + 1 if word[n : n + 1] == symbol else -1
                    if to >= 0 and so_far + cost < new.get(to, math.inf):
                        new[to] = so_far + cost
            reached = new
        return reached.get(len(word), math.inf) + self.cost(word)

    def best(self, seen: str, gaps: bool = False, spaces: bool = False) -> tuple[float, str]:
        """The likeliest letters behind what is seen, by Viterbi over its lattice, with their cost; words apart by spaces.

        Time is in proportion to the length.
        """
        log = self.log
        beams: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # the last three symbols: cost, (letters before, letter)
        for arcs in lattice(seen, gaps, spaces):
            new: dict[int, tuple[float, tuple]] = {}
            for state, (so_far, text) in beams.items():
                for symbol, cost in arcs:
                    if symbol is None or (symbol == " " and state % _SIZE == 0):  # one boundary is enough
                        to, found = state, (so_far + cost, text)
                    else:
                        to = state * _SIZE + code_of(symbol)
                        found = (so_far + cost - float(log[to]), (text, symbol))
                        to %= _SIZE**3
                    if to not in new or found[0] < new[to][0]:
                        new[to] = found
            beams = new
        # A boundary at the very end has been paid for.
        total, node = min(((cost if text and text[1] == " " else cost - float(log[state * _SIZE]), text) for state, (cost, text) in beams.items()), key=lambda x: x[0])
        said = []
        while node:
            node, letter = node
            said.append(letter)
        return total, "".join(reversed(said)).strip(" ")

    def words(self, seen: str) -> list[str]:
        """What a token or a run of spread letters says: as one word first, then as several."""
        return [self.decode(seen), *self.decode(seen, gaps=True).split(" ")]

    def apart(self, letters: str, a: int, b: int | None) -> float:
        """What it costs to set boundaries before a and (if given) before b, rather than where they are likeliest."""
        low = max(a - _AROUND, 0)
        letters = letters[low : (b or a) + _AROUND]
        return self._cost(letters, {a - low, (b or a) - low}) - self._cost(letters, set())

    def _cost(self, letters: str, parted: set[int]) -> float:
        beams = {0: 0.0}
        for i, c in enumerate(letters, 1):
            code, new = ord(c) - 96 if "a" <= c <= "z" else 27 if c > "\x7f" else 0, {}
            for state, so_far in beams.items():
                total, to = so_far - float(self.log[state * _SIZE + code]), (state * _SIZE + code) % _SIZE**3
                ended, after = total - float(self.log[to * _SIZE]), to * _SIZE % _SIZE**3
                if i not in parted:
                    new[to] = min(total, new.get(to, total))
                if i < len(letters):
                    new[after] = min(ended, new.get(after, ended))
                elif i in parted:
                    new[to] = min(total, new.get(to, total))
            beams = new
        return min(total - float(self.log[state * _SIZE]) for state, total in beams.items())


def odd_tokens(grid: Grid) -> np.ndarray:
    """Words (by white space, lowered) that hold a letter and an odd character, a letter three times or three doubled."""
    data, size = grid.data[:-8], len(grid.data) - 8
    count = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
    odd, letter = count(_ODD[data]), count(_LETTER[data])
    thrice = np.zeros(size, dtype=bool)
    if size > 2:
        thrice[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]]
    triple = count(thrice)
    twice = np.zeros(size, dtype=bool)
    if size > 1:
        twice[1:] = (data[1:] == data[:-1]) & _LETTER[data[1:]]
    doubled = count(twice)
    s, e = grid.starts, grid.ends
    length = e - s
    # One odd mark at the end of a word is mere punctuation.
    odd_here = odd[e] - odd[s] - (_ODD[data[e - 1]] & ~((data[e - 1] >= 48) & (data[e - 1] <= 57)) if size else 0)
    repeated = (triple[e] - triple[np.minimum(s + 2, e)] > 0) | (doubled[e] - doubled[np.minimum(s + 1, e)] > 2)
    return np.flatnonzero((length > 2) & (letter[e] > letter[s]) & ((odd_here > 0) | repeated))


def spread_words(grid: Grid) -> Iterator[tuple[int, int]]:
    """Runs of three words or more of one character each, as first word and word after the last."""
    single = np.zeros(len(grid.starts) + 2, dtype=bool)
    d = grid.data[grid.starts] if len(grid.starts) else np.zeros(0, dtype=np.uint8)
    single[1:-1] = (grid.ends - grid.starts == 1) & (_LETTER[d] | _ODD[d])
    same = np.zeros(len(single), dtype=bool)
    if len(d) > 1:
        same[2:-1] = grid.text_of[1:] == grid.text_of[:-1]
    begins = np.flatnonzero(single & ~(np.roll(single, 1) & same)) - 1
    if not len(begins):
        return
    goes_on = single & np.roll(single, 1) & same
    stops = np.flatnonzero(single & ~np.roll(goes_on, -1))
    for b, e in zip(begins.tolist(), stops.tolist(), strict=True):
        if e - b >= 3:
            yield b, e


def odd_places(grid: Grid) -> Iterator[tuple[int, int, str, bool]]:
    """What may be disguised: first word, word after the last, its characters, and whether they are spread letters."""
    for k in odd_tokens(grid).tolist():
        yield k, k + 1, bytes(grid.data[grid.starts[k] : grid.ends[k]]).decode(errors="replace"), False
    for b, e in spread_words(grid):
        yield b, e, bytes(grid.data[grid.starts[b:e]]).decode("latin-1"), True


def with_folded(texts: pa.Array) -> pa.Array:
    """The texts, those with look-alikes of other scripts folded and those with accented capitals lowered."""
    offsets, raw = string_buffers(texts)
    capital = (raw[:-1] == 0xC3) & (raw[1:] < 0x9F)
    of = lambda where: np.unique(np.searchsorted(offsets, np.flatnonzero(where), side="right") - 1).tolist()
    new = {i: texts[i].as_py().lower() for i in of(capital)}
    return replaced(texts, new | {i: folded(new.get(i) or texts[i].as_py()) for i in of(_FOREIGN_LEAD[raw])})


def replaced(texts: pa.Array, new: dict[int, str]) -> pa.Array:
    return pa.array([new.get(i, t) for i, t in enumerate(texts.to_pylist())], pa.string()) if new else texts


def spliced(texts: pa.Array, grid: Grid, edits: dict[int, list[tuple[int, int, str]]]) -> pa.Array:
    """The texts, with stretches of words (first, after the last) of some replaced."""
    new = {}
    for i, own in edits.items():
        at, parts = grid.offsets[i], []
        for b, e, said in sorted(own):
            parts += [bytes(grid.data[at : grid.starts[b]]), said.encode()]
            at = grid.ends[e - 1]
        new[i] = b"".join([*parts, bytes(grid.data[at : grid.offsets[i + 1]])]).decode(errors="replace")
    return replaced(texts, new)


def once(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


def features(word: bytes) -> list[bytes]:
    """A word and its beginnings (marked by a hyphen), as other languages' words are inflected."""
    return [word, *(word[:k] + b"-" for k in PREFIXES if len(word) > k)]


@dataclass
class Learned:
    """What the labelled rows tell: see ``fit``."""

    #: How likely a text with a feature is toxic; how a word with one weighs; how a word of each bucket leans.
    lexicon: dict[bytes, float] = field(default_factory=dict)
    weights: dict[bytes, float] = field(default_factory=dict)
    leans: np.ndarray = field(default_factory=lambda: np.zeros(LEANS))
    #: The logistic model over a text's evidence; none without labels of both classes.
    logistic: np.ndarray | None = None


_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Scorer:
    """Restores texts by the language model and the lexicon, and scores what they say."""

    def __init__(self, model: CharModel, learned: Learned):
        self.model, self.learned, lexicon = model, learned, learned.lexicon
        self.lexicon = sorted(lexicon)
        # A beginning tells what a word may be; alone it is evidence of the logistic model only.
        self.clean = np.log1p(-np.array([lexicon[w] if w[-1:] != b"-" else 0.0 for w in self.lexicon]))
        self.rank = {w: i for i, w in enumerate(self.lexicon)}
        self.words = [w for w in self.lexicon if w[-1:] != b"-"]
        self.words_said = [w.decode(errors="replace") for w in self.words]
        self.by_first = defaultdict(list)
        for w in self.words_said:
            self.by_first[w[0]].append(w)
        # A restored word may have lost or kept a double letter.
        self.by_once = {once(w.decode(errors="replace")): w.decode(errors="replace") for w in self.words}
        self.tables = _tables(self.lexicon, self.rank)
        self.weights = [(k, keys, np.array([learned.weights[w] for w in own])) for k, keys, own in _sorted(sorted(learned.weights))]
        by_length, by_beginning = defaultdict(set), defaultdict(set)
        for w in self.lexicon:
            said = w.decode(errors="replace")
            if w[-1:] == b"-":
                by_beginning[len(said) - 1].add(said[:-1])
            else:
                by_length[len(said)].add(said)
        self.by_length, self.by_beginning = sorted(by_length.items()), sorted(by_beginning.items())
        self.longest = max(map(len, self.words), default=0)
        powers = _powers(_BASE, self.longest + 1)
        keys = np.array([int((np.frombuffer(w, np.uint8).astype(U64) * powers[: len(w)]).sum(dtype=U64)) for w in self.words], dtype=U64)
        order = np.argsort(keys, kind="stable")
        self.joined_keys, self.joined_words = keys[order], [self.words[i] for i in order]
        self.known: dict[str, str] = {}

    def reading(self, seen: str, spread: bool) -> str:
        """What an odd token or a run of spread letters says; an empty string if it is plain after all."""
        if not spread:
            seen = core_of(seen)
        if not seen:
            return ""
        if seen not in self.known:
            if len(self.known) > _REMEMBERED:
                self.known = {}
            cost, one = self.model.best(seen)
            self.known[seen] = self._word(one) or self._nearly(seen, cost) or self._set_apart(self.model.decode(seen, gaps=True))
        return self.known[seen]

    def _word(self, said: str) -> str:
        if any(f in self.rank for f in features(said.encode())) if said else False:
            return said
        return self.by_once.get(once(said), "")

    def _nearly(self, seen: str, cost: float) -> str:
        """A word of the lexicon that is a reading of what is seen too, nearly as likely as the best."""
        if len(seen) > _OFTEN * self.longest:
            return ""
        of_first = self.by_first.get(seen[0], ()) if "a" <= seen[0] <= "z" else self.words_said
        letters = set(seen).union(*(LOOKS_LIKE.get(c, "") if c != "*" else _ANY for c in set(seen)))
        near = ((self.model.cost_as(seen, w), w) for w in of_first if len(w) <= len(seen) and letters.issuperset(w))
        found, word = min(near, default=(math.inf, ""))
        return word if found - cost <= len(word) * _LETTER_COST else ""

    def _set_apart(self, said: str) -> str:
        """Words of the lexicon set apart, within letters too wherever boundaries are about as likely as not."""
        said = " ".join(self._word(w) or w for w in said.split(" "))
        letters, cuts, n = [], set(), 0
        for w in said.split(" "):
            letters.append(w)
            n += len(w)
            cuts.add(n)
        letters = "".join(letters)
        for a in range(len(letters)):
            for k, own in reversed(self.by_length):
                if letters[a : a + k] in own and self.model.apart(letters, a, a + k) <= _APART_COST:
                    cuts = {c for c in cuts if not a < c < a + k} | {a, a + k}
                    break
            else:
                for k, own in reversed(self.by_beginning):
                    if letters[a : a + k] in own and a + k < len(letters) and self.model.apart(letters, a, None) <= _APART_COST:
                        cuts = {c for c in cuts if not a < c <= a + k} | {a}
                        break
        at = sorted(cuts | {0, len(letters)})
        return " ".join(letters[x:y] for x, y in zip(at[:-1], at[1:], strict=True))

    def restored(self, texts: pa.Array) -> pa.Array:
        """The texts as they are read; where anything was restored, letters are lowered."""
        return self._restored(texts)[0]

    def _restored(self, texts: pa.Array) -> tuple[pa.Array, Grid]:
        texts = with_folded(texts)
        if self.lexicon:
            grid, edits = Grid(texts, SPACED, lower=True), defaultdict(list)
            for b, e, seen, spread in odd_places(grid):
                if said := self.reading(seen, spread):
                    edits[int(grid.text_of[b])].append((b, e, said))
            texts = spliced(texts, grid, edits)
        grid = Grid(texts, PLAIN, lower=True)
        edits = defaultdict(list)
        for b, e, said in self._split(grid):
            edits[int(grid.text_of[b])].append((b, e, said))
        if edits:
            texts = spliced(texts, grid, edits)
            grid = Grid(texts, PLAIN, lower=True)
        return texts, grid

    def _split(self, grid: Grid) -> Iterator[tuple[int, int, str]]:
        """Neighbouring words that are a word of the lexicon together, if the language model finds that about as likely.

        Candidates are found by a hash that joins: that of two words follows from theirs.
        """
        n, length = len(grid.starts), grid.ends - grid.starts
        if n < 2 or not self.words:
            return
        up = _powers(_BASE, self.longest + 2)
        own = np.zeros(n, dtype=U64)
        for k in range(self.longest):
            here = np.flatnonzero(length > k)
            own[here] += grid.data[grid.starts[here] + k].astype(U64) * up[k]
        near = (grid.starts[1:] - grid.ends[:-1] <= _BETWEEN) & (grid.text_of[1:] == grid.text_of[:-1])
        joined, width, ok, found = own, length, np.ones(n, dtype=bool), []
        for k in range(1, min(_PARTS, n)):
            joined = joined[: n - k] + own[k:] * up[np.minimum(width[: n - k], self.longest + 1)]
            width = width[: n - k] + length[k:]
            ok = ok[: n - k] & near[k - 1 :] & (width <= self.longest)
            here = np.flatnonzero(ok)
            at = np.searchsorted(self.joined_keys, joined[here])
            hit = at < len(self.joined_keys)
            hit[hit] = self.joined_keys[at[hit]] == joined[here[hit]]
            found += [(int(i), int(i) + k + 1, self.joined_words[j]) for i, j in zip(here[hit], at[hit], strict=True)]
        after = 0
        for b, e, word in sorted(found):
            parts = [bytes(grid.data[grid.starts[i] : grid.ends[i]]) for i in range(b, e)]
            if b < after or b"".join(parts) != word:
                continue
            seen, said = b" ".join(parts).decode(errors="replace"), word.decode(errors="replace")
            if self.model.cost_as(seen, said, spaces=True) - self.model.best(seen, spaces=True)[0] <= len(said) * _LETTER_COST:
                yield b, e, said
                after = e

    def evidence(self, grid: Grid) -> np.ndarray:
        """What the distinct words of each text weigh, and how they lean, as the logistic model takes it."""
        order = np.lexsort([grid.hashes, grid.text_of])
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (grid.text_of[order][1:] != grid.text_of[order][:-1]) | (grid.hashes[order][1:] != grid.hashes[order][:-1])
        at = order[fresh]
        text, length, value = grid.text_of[at], (grid.ends - grid.starts)[at], np.zeros(len(at))
        for k, keys, weight in self.weights:
            seen = grid.begins(k)[at] if k else grid.hashes[at]
            i = np.minimum(np.searchsorted(keys, seen), len(keys) - 1)
            value = np.maximum(value, np.where((keys[i] == seen) & (length > k), weight[i], 0.0))
        count = lambda w=None: np.bincount(text, weights=w, minlength=len(grid))
        n, total = count(), count(value)
        lean = count(self.learned.leans[buckets_of(grid, at)])
        return np.stack([total, total / np.sqrt(1 + n), np.log(np.maximum(n, FEW_WORDS)), lean / (n + 20), np.ones(len(grid))], axis=1)

    def features(self, grid: Grid) -> np.ndarray:
        """Distinct pairs of (text, feature of the lexicon)."""
        pairs = [np.zeros((0, 2), dtype=np.int64)]
        for k, keys, which in self.tables:
            if len(grid.starts):
                seen = grid.hashes if not k else grid.begins(k)
                at = np.minimum(np.searchsorted(keys, seen), len(keys) - 1)
                hit = np.flatnonzero((keys[at] == seen) & (grid.ends - grid.starts > k))
                pairs.append(np.stack([grid.text_of[hit], which[at[hit]]], axis=1))
        return np.unique(np.concatenate(pairs), axis=0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.judged(texts)[0]

    def judged(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Scores, and the restored texts that were scored."""
        restored, grid = self._restored(texts)
        if self.learned.logistic is None:
            return np.zeros(len(texts)), restored
        # Not toxic: neither by the logistic model nor by any feature of the lexicon.
        total = -np.logaddexp(0.0, self.evidence(grid) @ self.learned.logistic)
        pairs = self.features(grid)
        np.add.at(total, pairs[:, 0], self.clean[pairs[:, 1]])
        return -np.expm1(total), restored


def core_of(token: str) -> str:
    """The disguised part of an odd token; nothing if it is plain."""
    core = token.rstrip(_END)
    if core == token and token.endswith("$$$"):
        core = token.rstrip("$")
    core = core.lstrip(_START)
    return core if _STRANGE.search(core) and re.search("[a-z].*[a-z]|[a-z].{2}|.{2}[a-z]", core) else ""


def buckets_of(grid: Grid, at: np.ndarray) -> np.ndarray:
    return (mix(grid.begins(4)[at]) & U64(LEANS - 1)).astype(np.int64)


def _sorted(features: list[bytes]) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """Keys of whole words (0) and of beginnings by length, sorted, with the features in that order."""
    whole = [w for w in features if w[-1:] != b"-"]
    by_length = {k: [w for w in features if w[-1:] == b"-" and len(w) == k + 1] for k in PREFIXES}
    grid = Grid(pa.array([w.decode(errors="replace") for w in whole], pa.string()), PLAIN, lower=True)
    for k, own, keys in ((0, whole, grid.hashes), *((k, own, np.array([int.from_bytes(w[:k], "little") for w in own], dtype=U64)) for k, own in by_length.items())):
        if own:
            order = np.argsort(keys, kind="stable")
            yield k, keys[order], [own[i] for i in order]


def _tables(features: list[bytes], rank: dict[bytes, int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return [(k, keys, np.array([rank[w] for w in own], dtype=np.int64)) for k, keys, own in _sorted(features)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit_language_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Counts over all documents; what reaches the driver is bounded by the number of possible grams."""
    seen = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(gram_counts, "gram long, n long")
    counts = np.zeros(_SIZE**4, dtype=np.int64)
    table = seen.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts[table["gram"].to_numpy()] = table["n"].to_numpy()
    return CharModel(counts)


def _features_of(model):
    """The features of each row, how many of its words have each, and how many words it has."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = model.value
        for run in runs(batches, limit=1 << 18):  # many small objects a word
            texts = with_folded(column(run, "text"))
            spaced = Grid(texts, SPACED, lower=True)
            more: dict[int, set[str]] = defaultdict(set)
            for b, _, seen, spread in odd_places(spaced):
                if said := seen if spread else core_of(seen):
                    more[int(spaced.text_of[b])].update(lm.words(said))
            plain, own, times, n = Grid(texts, PLAIN, lower=True), [], [], []
            data = plain.data.tobytes()
            spans = list(zip(plain.starts.tolist(), plain.ends.tolist(), strict=True))
            for i in range(len(run)):
                words = {data[a:b] for a, b in spans[plain.first[i] : plain.first[i + 1]]}
                n.append(len(words))
                words = {w for w in words | {w.encode() for w in more[i]} if len(w) >= 3}
                count: dict[bytes, int] = defaultdict(int)
                for w in words:
                    for f in features(w):
                        count[f] += 1
                own.append(list(count))
                times.append([min(c, MOST_A_ROW) for c in count.values()])
            yield pa.RecordBatch.from_pydict({"toxic": column(run, "toxic"), "features": pa.array(own, pa.list_(pa.binary())), "times": pa.array(times, pa.list_(pa.int32())), "n_words": pa.array(n, pa.int64())})

    return each


def _leaning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many distinct words of the rows of each class fall into each bucket."""
    total = np.zeros((2, LEANS), dtype=np.int64)
    for run in runs(batches):
        grid = Grid(column(run, "text"), PLAIN, lower=True)
        kinds = np.unique(np.stack([grid.text_of, buckets_of(grid, np.arange(len(grid.starts)))], axis=1), axis=0)
        np.add.at(total, (column(run, "toxic").to_numpy()[kinds[:, 0]], kinds[:, 1]), 1)
    toxic, bucket = np.nonzero(total)
    yield pa.RecordBatch.from_pydict({"toxic": pa.array(toxic, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "n": pa.array(total[toxic, bucket], pa.int64())})


def _logistic(x: np.ndarray, y: np.ndarray, odds: float) -> np.ndarray:
    """Weights by Newton's steps with a slight pull to zero; the last is the constant, set for the odds of all rows.

    How a text leans weighs one: the rows that it is learned from lean further than others, so its weight isn't fitted.
    """
    w = np.zeros(x.shape[1])
    w[LEANING] = 1.0
    free = np.arange(len(w)) != LEANING
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        f = x[:, free]
        slope = f.T @ (p - y) + 0.01 * w[free]
        w[free] -= np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + 0.01 * np.eye(f.shape[1]), slope)
    w[-1] += math.log(odds)
    return w


def learning_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[DataFrame | None, dict[int, int]]:
    """(toxic, text) of at most ``rows`` labelled rows of each class, without copies; how many rows each class has.

    Of rows of a class that are copies by their whole texts (components as in op7) the one whose id has the lowest
    hash counts.
    """
    own = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    all_rows = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(all_rows) < 2:
        return None, all_rows
    by_hash = lambda c: own.filter(F.col("toxic") == c).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    chosen = by_hash(1).unionAll(by_hash(0))
    texts = id_and_text(docs, id_col, text_col)
    first = F.min(F.struct("hash", "doc_id", "text")).alias("row")
    # At most 2 * rows rows are broadcast.
    met = texts.join(F.broadcast(chosen), "doc_id").withColumn("hash", F.xxhash64(F.col("doc_id").cast("string")))
    whole = met.groupBy("toxic", F.sha2(F.lower("text"), 256).alias("whole")).agg(first).select("toxic", "row.*")
    whole = written(whole.withColumn("place", F.monotonically_increasing_id()), "toxic-rows")
    classes = near_duplicate_classes(whole, COPY_WIDTH, COPY_PERCENT, id_col="place").select(F.col("doc_id").alias("place"), "component_id")
    picked = whole.join(classes, "place").groupBy("toxic", "component_id").agg(first).select("toxic", "row.text")
    return written(picked.select("toxic", "text"), "toxic-picked"), all_rows


def fit(model, picked: DataFrame, all_rows: dict[int, int]) -> Learned:
    """What the rows (toxic, text) tell, under a broadcast language model.

    A feature is of the lexicon if it is in so many toxic rows that none of all features would be by chance, and if at
    least ``MIN_SHARE`` of the rows with it are toxic. It has a weight if more words with it stand in toxic rows than
    chance would give any of all features: the log of how much more frequent it is there.
    """
    sample = written(picked.mapInArrow(_features_of(model), "toxic int, features array<binary>, times array<int>, n_words long"), "toxic-features")
    n = {r["toxic"]: (r["n"], r["words"]) for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("n_words").alias("words")).collect()}
    if len(n) < 2:
        return Learned()
    toxic_row = F.col("toxic") == 1
    sums = [F.sum(F.when(on, x).otherwise(0)).alias(name) for name, on, x in (("t", toxic_row, F.lit(1)), ("c", ~toxic_row, F.lit(1)), ("tw", toxic_row, F.col("p.times")), ("cw", ~toxic_row, F.col("p.times")))]
    counts = written(sample.select("toxic", F.explode(F.arrays_zip("features", "times")).alias("p")).groupBy(F.col("p.features").alias("f")).agg(*sums), "toxic-counts")
    n_features = counts.count()
    share = n[1][0] / (n[0][0] + n[1][0])
    least = (math.log(n_features + 1) + 1) / -math.log(share)
    # Of the clean rows a part may be missing from the sample.
    clean = F.col("c") * max(1.0, (all_rows[0] / n[0][0]) / (all_rows[1] / n[1][0]))
    toxic = (F.col("t") + 0.5) / (F.col("t") + clean + 1)
    telling = {bytes(r["f"]): (min(r["p"], 0.995), r["t"]) for r in counts.withColumn("p", toxic).filter((F.col("t") >= least) & (F.col("p") >= MIN_SHARE)).collect()}
    # A beginning that is mostly one whole word says no more than that word.
    most: dict[bytes, int] = defaultdict(int)
    for f, (_, t) in telling.items():
        for b in features(f)[1:] if f[-1:] != b"-" else ():
            most[b] = max(most[b], t)
    lexicon = {f: p for f, (p, t) in telling.items() if 10 * most[f] < 9 * t}

    words = {k: max(w, 1) for k, (_, w) in n.items()}
    expected = words[1] / (words[0] + words[1])
    both = F.col("tw") + F.col("cw")
    gain = F.col("tw") * F.log(F.col("tw") / (both * expected)) + F.when(F.col("cw") > 0, F.col("cw") * F.log(F.col("cw") / (both * (1 - expected)))).otherwise(0.0)
    weight = F.log((F.col("tw") + 0.5) / words[1]) - F.log((F.col("cw") + 0.5) / words[0])
    more = counts.filter((F.col("t") >= 2) & (F.col("tw") > both * expected)).filter(gain > math.log(n_features + 1) + 1)
    weights = {bytes(r["f"]): r["w"] for r in more.select("f", weight.alias("w")).collect()}

    lean = np.zeros((2, LEANS))
    for r in picked.mapInArrow(_leaning, "toxic long, bucket long, n long").groupBy("toxic", "bucket").agg(F.sum("n").alias("n")).collect():
        lean[r["toxic"], r["bucket"]] = r["n"]
    lean = np.log((lean + 5) / (lean.sum(axis=1, keepdims=True) + 5 * LEANS))
    learned = Learned(lexicon, weights, np.clip(lean[1] - lean[0], -1, 1))

    scorer = picked.sparkSession.sparkContext.broadcast(Scorer(model.value, learned))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, limit=_RUN):
            x = scorer.value.evidence(scorer.value._restored(column(run, "text"))[1])
            yield pa.RecordBatch.from_pydict({"toxic": column(run, "toxic")} | {f"x{k}": pa.array(x[:, k]) for k in range(x.shape[1])})

    # As many rows as the sample has, and some numbers each.
    table = np.array(sorted(tuple(r) for r in picked.mapInArrow(judge, "toxic int, x0 double, x1 double, x2 double, x3 double, x4 double").collect()))
    learned.logistic = _logistic(table[:, 1:], table[:, 0], (all_rows[1] / all_rows[0]) / (n[1][0] / n[0][0]))
    return learned


def fitted_scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """A broadcast scorer learned from the documents and labels; bounded by the model's symbols and the sample."""
    context = docs.sparkSession.sparkContext
    model = fit_language_model(docs, text_col)
    with only_kept(docs.sparkSession):
        picked, all_rows = learning_rows(docs, labels, id_col=id_col, text_col=text_col)
        learned = Learned() if picked is None else fit(context.broadcast(model), picked, all_rows)
    return context.broadcast(Scorer(model, learned))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, restored (the text as it was read)."""
    scorer = fitted_scorer(docs, labels, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, limit=_RUN):
            scores, restored = scorer.value.judged(column(run, "text"))
            yield pa.RecordBatch.from_pydict({"doc_id": column(run, "doc_id"), "score": pa.array(scores, pa.float64()), "restored": restored})

    kind = id_field(docs, id_col).dataType.simpleString()
    scored = id_and_text(docs, id_col, text_col).mapInArrow(score, f"doc_id {kind}, score double, restored string")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "restored")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, whole rows, that score below the threshold."""
    scorer = fitted_scorer(docs, labels, id_col, text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, text_col, limit=_RUN):
            yield run.filter(pa.array(scorer.value.scores(column(run, text_col)) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracery.llm.tables import read

    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("restored")
