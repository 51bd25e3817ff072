"""Problem 9: sentences of every document, by a hidden-event n-gram language model.

A text is a sequence of tokens: words, single signs of scripts without blanks, runs of
end marks, other marks. Between any two tokens a boundary token may be hidden. What the
task itself fixes is cut or closed beforehand: blank lines, line ends of recognised text
and blanks between Thai signs always end a sentence, nothing inside quotation marks or
brackets does, nor the number of a list item, and closing marks belong to what they close.

All other gaps are decided by the model. At each, a boundary has the probability of the
boundary token given the history, and then the next two tokens that of tokens after a
boundary token; without one they have that of tokens inside sentences. A boundary changes
the history of the gap after it, so neighbouring gaps form a chain with two states, and
forward-backward gives the posteriors. A boundary is set where its posterior exceeds one
half.

Nobody has marked the sentences, but the ends of paragraphs are sure boundaries, and a
writer starts paragraphs for other reasons than the words at hand. So of the boundaries
after a history a fixed part is visible, and one in ``1 + r`` is the end of a paragraph,
r being estimated from how often words that begin paragraphs also follow marks inside
them. A history that has ended x paragraphs then has a boundary at about r x of its gaps,
and one that stands before many gaps and hardly ever ends a paragraph is an abbreviation,
a number, or whatever else its language has. Rare histories lean on shorter ones: on the
shape of the word before the mark, on the mark, on the kind of mark.

Text without any end mark is decided by histories of words alone, which are counted as if
marks were not there; inside text with marks such a boundary has the share of boundaries
without a mark that r shows. No word list, no odds set by hand and no limit on n-grams is
used: counts of all documents but recognised text (whose lines are cut by layout) go to a
table, which is sent to the workers if its counted rows are within MOST_SENT, and is
joined to the n-grams of each document beyond that. Both give the same boundaries.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.runtime import Scratch, spread

#: Rows of counts (24 bytes each) up to which they are sent to every worker; more are joined.
MOST_SENT = 2_000_000
#: Signs that are taken apart at once, so that long texts pass in whole but few at a time.
AT_ONCE = 1_000_000
#: Weight of a shorter history, in visible boundaries; of the same after the next token, in tokens.
LEAN, LEAN_NEXT = 1.0, 2.0
#: No history is surer than this of a boundary: writers err.
SUREST = 0.998
#: A gap whose boundary is less likely than this in either state is left out of its neighbours' histories.
SLIGHT = 1e-4

# Marks that may end a sentence, and the pairs of quotation marks and brackets.
END = ".!?…。！？．｡।॥؟۔։።၊။។៕།"
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》", "〈": "〉", "“": "”", "‘": "’", "„": "“”", "‚": "‘’", "«": "»", "‹": "›"}
_MARK = set("\"'()[]{}（）［］【】〔〕「」『』《》〈〉“”‘’„‚«»‹›")
_CLOSER = set(")]}）］】〕」』》〉”’")
# Fixed values, as ranges: punctuation, and scripts that are written without blanks sign by sign.
_PUNCT = r"!-/:-@\[-\^`{-~¡-©«-±´¶-¸»¿՚-՟։־׃،؛؟٪-٭۔।॥༈-༔၊-၏፡-፨។-៚‐-‧‰-⁞←-⏿　-〄〇-〠〰〽-〿・！-／：-＠［-｀｛-･"
_WIDE = r"々〆぀-ヺー-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"

#: Stands between texts that are taken apart together; a lone surrogate can't occur in one.
_BAR = "\ud800"
_LETTER = rf"[^\s{_PUNCT}{_WIDE}{_BAR}]"
_UPPER, _LOWER = ("".join(chr(i) for i in range(0x530) if is_case(chr(i))) for is_case in (str.isupper, str.islower))
#: A period between two words without a blank parts them if lower case stands before it and a capitalised word after it.
_PARTED = rf"(?!(?<=[{_LOWER}]\.)[{_UPPER}](?:[{_LOWER}]|\s))"
_ITEM = re.compile(rf"\s*(?:{_LETTER}+(?:(?:[.'’\-:/]{_PARTED}|,(?=\d)){_LETTER}+)*|[{re.escape(END)}]+|\S)")
_DIGITS = re.compile(r"\d+(?:[.,:]\d+)*")
_NOISE = re.compile("[\u0301\u200b-\u200f\ufeff\x00-\x08\x0e-\x1b]+")
_BREAK = re.compile("\r\n|[\n\r\v\f\x85\u2028\u2029]")
_REPEAT = re.compile(r"(.)\1+")
_MARKS = re.compile("[" + re.escape("".join(sorted(_MARK))) + "]")
_THAI = re.compile("[ก-๿]")

_BLANK, _LINE, _PARAGRAPH = 1, 2, 3
_WORD, _ENDING, _OTHER, _STOP, _NOTHING = range(5)


def _shape(word: str, kind: int) -> int:
    """How a token looks: its kind, and of a word its case and length."""
    if kind != _WORD:
        return kind
    if word[0] == "0":
        look = 1
    elif "0" in word or "_" in word:
        look = 2
    elif word.islower():
        look = 3
    elif word.isupper():
        look = 4
    elif word[0].isupper():
        look = 5
    else:
        look = 6 if word.upper() != word.lower() else 7 if len(word) > 1 else 8
    return 10 * look + min(len(word), 5)


class Items(dict):
    """The distinct tokens (with the blanks before them), numbered, and what is known of each."""

    #: Tokens after which the numbers start afresh.
    MOST = 500_000
    KINDS = (np.int32, np.int8, np.int32, bool, np.uint64, np.uint64, np.int8, bool, bool, bool, bool, bool)

    def __init__(self):
        super().__init__()
        self.rows: list[tuple] = []
        self.table: list[np.ndarray] = []
        self.leads: dict[str, tuple] = {"": (0, 0), " ": (1, _BLANK)}
        self.forms: dict[str, tuple] = {}

    def __missing__(self, item: str) -> int:
        at = self[item] = len(self.rows)
        body = item.lstrip()
        blanks = item[: len(item) - len(body)]
        lead = self.leads.get(blanks)
        if lead is None:
            breaks = len(_BREAK.findall(blanks))
            lead = self.leads[blanks] = (len(blanks), _PARAGRAPH if breaks > 1 else _LINE if breaks else _BLANK)
        # Numbers are many and all alike.
        number = _DIGITS.sub("0", body)
        form = self.forms.get(number)
        if form is None:
            form = self.forms[number] = self._form(number)
        self.rows.append((*lead, len(item), len(body) == 1 and body.isascii() and body.isalpha() or number == "0" and len(body) <= 3 and body.isdigit(), *form))
        return at

    @staticmethod
    def _form(body: str) -> tuple:
        plain = body if body.isascii() and body.isprintable() else _NOISE.sub("", body)
        if body == _BAR:
            kind = _STOP
        elif not plain:
            kind = _NOTHING
        elif plain[0] in END:
            kind, plain = _ENDING, _REPEAT.sub(r"\1", plain)
        elif len(plain) == 1 and not plain.isalnum():
            kind = _OTHER
        else:
            kind, plain = _WORD, plain if plain.isascii() else _DIGITS.sub("0", unicodedata.normalize("NFKC", plain))
        digest = int.from_bytes(hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        thai = (_THAI.match(plain[0]) is not None, _THAI.match(plain[-1]) is not None) if plain and not plain.isascii() else (False, False)
        return digest, _shape(plain, kind) if plain else 0, kind, body in _MARK, body in _CLOSER, *thai, body in ")．" or body == "."

    def known(self) -> list[np.ndarray]:
        have = len(self.table[0]) if self.table else 0
        if have < len(self.rows):
            new = [np.array(c, dtype=k) for c, k in zip(zip(*self.rows[have:], strict=True), self.KINDS, strict=True)]
            self.table = [np.concatenate([a, b]) for a, b in zip(self.table, new, strict=True)] if have else new
        return self.table


def _mix(a, b):
    """A 64-bit key of two."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


#: The boundary token in a history, and what tells keys of one use from those of another.
_BOUNDARY = np.uint64(5)
_OF_MARK, _OF_LOOK, _OF_KIND, _OF_WORD, _OF_NEXT, _OF_NEXT_LOOK = (np.uint64(i) for i in (1, 77, 99, 13, 7, 8))
#: Rows of counts: a history (paragraphs ended, gaps inside), a next token (paragraphs begun, others), a total.
_HISTORY, _NEXT, _TOTAL = 0, 1, 2
_TOTAL_MARKED, _TOTAL_PLAIN = np.uint64(1), np.uint64(2)


def _shift(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Each token's neighbour before; the boundary token at a cut."""
    out = np.roll(values, 1)
    out[cut] = _BOUNDARY
    return out


class Lattice:
    """The tokens of some texts and the gaps after them: which are open, which are sure boundaries.

    ``lines``: which texts are recognised text. All arrays are by token, over all texts.
    """

    def __init__(self, texts: list[str], lines: list[bool], items: Items):
        joined = _BAR.join(texts) + _BAR
        found = _ITEM.findall(joined)
        ids = np.fromiter(map(items.__getitem__, found), np.int32, len(found))
        lead, breaks, size, listed, digest, look, kind, mark, closer, thai_first, thai_last, list_mark = items.known()
        ends = np.cumsum(size[ids], dtype=np.int64)
        kinds, lead_break = kind[ids], breaks[ids]
        stop = kinds == _STOP
        doc = np.cumsum(stop) - stop
        self.base = np.concatenate([[0], ends[stop][:-1]])
        lined = np.asarray(lines, bool)[doc]
        first = np.append(True, stop[:-1])
        cut = first | stop | (lead_break == _PARAGRAPH) | ((lead_break == _LINE) & lined)
        keep = np.flatnonzero((kinds != _NOTHING) | cut)  # what can't be seen goes with the token before it
        k = self.ids = ids[keep]
        self.n, self.digest, self.look, self.kind, self.doc = len(k), digest[k], look[k], kinds[keep], doc[keep]
        self.stop, self.cut, before = stop[keep], cut[keep], lead_break[keep]
        self.paired = mark[k]
        self.start = (ends - size[ids] + lead[ids])[keep]
        self.end = ends[np.append(keep[1:], len(ids)) - 1]
        after_cut = np.append(self.cut[1:], True)

        self.piece = np.cumsum(self.cut) - 1
        self.pieces = int(self.piece[-1]) + 1
        ending = self.kind == _ENDING
        self.has_end = np.bincount(self.piece[ending], minlength=self.pieces) > 0
        inside = self._inside(joined, mark[k], ending)
        thai = np.zeros(self.n, bool)
        thai[:-1] = thai_last[k][:-1] & thai_first[k][1:] & (before[1:] > 0)
        self.paragraph = after_cut & ~self.stop
        self.sure = (after_cut | (thai & ~inside)) & ~self.stop
        closes = (np.append(self.kind[1:], _STOP) == _ENDING) | np.append(closer[k][1:], False)
        self.open = ~self.sure & ~inside & ~self.stop & ~closes
        head = listed[k] & (self.cut | (before == _LINE))
        self.open[1:] &= ~(head[:-1] & list_mark[k][1:] & ~self.cut[1:])
        self.open[:-1] &= (self.kind[:-1] != _WORD) | (self.kind[1:] == _WORD)  # without an end mark, only words begin a sentence
        self.inside = inside
        self.plain = ~self.has_end[self.piece]  # in a piece without end marks
        self.counted = ~lined[keep] & ~self.stop

    def _inside(self, joined: str, marks: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """Which gaps lie inside quotation marks or brackets. Only pieces are looked at in which an end mark may do so, or that have none."""
        at = np.flatnonzero(marks)
        depth = np.zeros(self.n + 1, np.int32)
        if len(at):
            p = self.piece[at]
            new = np.append(True, p[1:] != p[:-1])
            first, last = at[new], at[np.append(new[1:], True)]
            seen = np.append(0, np.cumsum(ending))
            wanted = (last > first) & ((seen[last] > seen[first]) | ~self.has_end[p[new]])
            begins = np.flatnonzero(self.cut)
            which = p[new][wanted]
            opens, closes = [], []
            for a, z in zip(self.start[begins[which]].tolist(), self.end[np.append(begins[1:], self.n)[which] - 1].tolist(), strict=True):
                for x, y in pairs(joined[a:z]):
                    opens.append(a + x)
                    closes.append(a + y)
            if opens:
                np.add.at(depth, np.searchsorted(self.start, opens, "right") - 1, 1)
                np.add.at(depth, np.searchsorted(self.start, closes, "right") - 1, -1)
                depth = np.cumsum(depth)
        return depth[: self.n] > 0

    def histories(self, at: np.ndarray, after_boundary: bool = False) -> list[np.ndarray]:
        """Keys of the histories of the gaps after tokens that are no words, from the shortest on; with a boundary just before the token, or none."""
        if after_boundary:
            one = two = np.full(len(at), _BOUNDARY)
            look = one
        else:
            if not hasattr(self, "_before"):
                one = _shift(self.digest, self.cut)
                self._before = (one, _shift(one, self.cut), _shift(self.look, self.cut))
            one, two, look = (x[at] for x in self._before)
        mark = _mix(self.digest[at], _OF_MARK)
        pair = _mix(mark, one)
        return [_mix((2 * self.kind[at] + self.paired[at]).astype(np.uint64), _OF_KIND), mark, _mix(mark ^ _OF_LOOK, look), pair, _mix(pair, two)]

    def word_histories(self, at: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
        """The same for words, as if marks were not there; ``before``: the word before each."""
        word = _mix(self.digest[at], _OF_WORD)
        return [word, _mix(word, before)]

    def words(self, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of ``among``, the word before each in its piece (or the boundary token), and whether it is the last there."""
        at = np.flatnonzero(among & (self.kind == _WORD))
        p = self.piece[at]
        new = np.append(True, p[1:] != p[:-1])[: len(p)]
        return at, _shift(self.digest[at], new), np.append(new[1:], True)[: len(p)]


def pairs(text: str) -> list[tuple[int, int]]:
    """Matching quotation marks and brackets (open, close). Apostrophes and inch marks are none; a mark without its partner is ignored."""
    found, stack = [], []
    seen, double, n = 0, text.count('"'), len(text)
    for m in _MARKS.finditer(text):
        c, i = m.group(), m.start()
        before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < n else " "
        if c == '"':
            seen += 1
            is_open = any(x[0] == '"' for x in stack)
            if before.isdigit() and not (is_open and seen == double):
                continue  # an inch mark
            wanted = '"' if is_open else None
            opens = not is_open and not after.isspace()
        elif c == "'":
            if (before.isalnum() and after.isalnum()) or (before.isdigit() and not any(x[0] == "'" for x in stack)):
                continue
            is_open = any(x[0] == "'" for x in stack)
            wanted = "'" if is_open and not after.isalnum() else None
            opens = not is_open and not before.isalnum() and not after.isspace()
        elif c in "’‘" and before.isalnum() and after.isalnum():
            continue
        else:
            wanted, opens = None, c in PAIRS
            for k in range(len(stack) - 1, -1, -1):
                if c in PAIRS.get(stack[k][0], "") or (c == "«" and stack[k][0] == "»"):
                    wanted, opens = stack[k][0], False
                    break
            if c == "»" and wanted is None and not after.isspace():
                opens = True
        if wanted is not None:
            while stack:
                top, at = stack.pop()
                if top == wanted:
                    found.append((at, i))
                    break
        elif opens:
            stack.append((c, i))
    return found


def _tally(keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """How often each key occurs in each of the arrays."""
    found = [np.unique(k, return_counts=True) for k in keys]
    every = np.unique(np.concatenate([k for k, _ in found]))
    out = []
    for k, n in found:
        column = np.zeros(len(every), np.int64)
        column[np.searchsorted(every, k)] = n
        out.append(column)
    return every, out


def count(at: Lattice) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Kind, keys and columns of what a lattice adds to the counts."""
    ends, gaps = at.paragraph & at.counted & (at.kind != _WORD), at.open & at.counted & (at.kind != _WORD)
    e, g = np.flatnonzero(ends), np.flatnonzero(gaps)
    plain = at.paragraph & at.counted & (at.kind == _WORD)
    yield _TOTAL, np.array([_TOTAL_MARKED, _TOTAL_PLAIN]), [np.array([len(e), plain.sum()]), np.array([len(g), 0])]
    for x, y in zip(at.histories(e), at.histories(g), strict=True):
        yield _HISTORY, *_tally([x, y])
    w, before, last = at.words(at.counted & at.has_end[at.piece])
    closed = at.inside[w] & np.append(at.inside[w][1:], False)
    for key in at.word_histories(w, before):
        yield _HISTORY, *_tally([key[last], key[~last & ~closed]])
    # Distinct tokens are few, so single ones are counted by number.
    first, other = np.flatnonzero(at.cut & at.counted), np.flatnonzero(~at.cut & at.counted)
    after, between = g + 1, np.flatnonzero(at.open & at.counted & (at.kind == _WORD)) + 1
    kinds = int(at.ids.max()) + 1
    columns = [np.bincount(at.ids[x], minlength=kinds) for x in (first, other, after, between)]
    numbers = np.flatnonzero(sum(columns))
    digest, look = np.zeros(kinds, np.uint64), np.zeros(kinds, np.uint64)
    digest[at.ids], look[at.ids] = at.digest, at.look
    yield _NEXT, _mix(digest[numbers], _OF_NEXT), [c[numbers] for c in columns]
    yield _HISTORY, _mix(look[numbers], _OF_NEXT_LOOK), [c[numbers] for c in columns[:2]]
    follower = _follower(at)
    yield _HISTORY, *_tally([_mix(_mix(at.digest[x], _OF_NEXT), follower[x]) for x in (first, other)])


def _follower(at: Lattice) -> np.ndarray:
    out = np.roll(at.digest, -1)
    out[np.append(at.cut[1:], True)] = _BOUNDARY
    return out


class Model:
    """Counts by key, the sums of all next tokens, and ``r`` with and without an end mark."""

    def __init__(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray, totals: dict[str, float]):
        self.keys, self.a, self.b = keys, a, b
        self.begun, self.other = totals["begun"] + 1.0, totals["other"] + 1.0
        self.types, self.r = totals["types"] + 1.0, totals["r"]
        self.unmarked = totals["unmarked"]

    def _counts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys))
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[i] == keys
        return np.where(known, self.a[i], 0.0), np.where(known, self.b[i], 0.0)

    def boundary(self, histories: list[np.ndarray]) -> np.ndarray:
        """P(boundary | history): of boundaries after it one in 1 + r is visible, so x of them stand for r x inside."""
        p = np.zeros(len(histories[0]))
        for keys in histories:
            ends, gaps = self._counts(keys)
            p = np.minimum((LEAN * p + ends) / (LEAN + gaps / self.r), SUREST)
        return p

    def follows(self, digest: np.ndarray, look: np.ndarray, follower: np.ndarray, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """P(next two tokens | boundary) / P(next two tokens | none).

        A new token has the odds of its look. After a ``word``, where no mark tells, only tokens known to begin something do,
        and a token that often follows that word (``before``) speaks against a boundary by as much.
        """
        looks_begun, looks_other = self._counts(_mix(look, _OF_NEXT_LOOK))
        of_begun, of_other = (looks_begun + 0.5) / self.begun, (looks_other + 0.5) / self.other
        key = _mix(digest, _OF_NEXT)
        begun, other = self._counts(key)
        share = (begun + other + 1e-3) / (looks_begun + looks_other + 1.0)
        first = (begun + self.types * share * of_begun) / (self.begun + self.types) / ((other + self.types * share * of_other) / (self.other + self.types))
        if word.any():
            first = np.where(word & (begun == 0), np.minimum(first, self.types / (self.begun + self.types)), first)
            began, stood = self._counts(_mix(before, _OF_NEXT))
            together = sum(self._counts(_mix(_mix(before, _OF_NEXT), digest)))
            usual = (begun + other + 1e-3) / (self.begun + self.other)
            first *= np.where(word, np.minimum(1.0, usual * (began + stood + LEAN_NEXT) / (together + LEAN_NEXT * usual)), 1.0)
        begun2, other2 = self._counts(_mix(key, follower))
        share = (begun2 + other2 + 0.1) / (begun + other + 1.0)
        second = (begun2 + LEAN_NEXT * share) / (begun + LEAN_NEXT) / ((other2 + LEAN_NEXT * share) / (other + LEAN_NEXT))
        return first * second

    def posteriors(self, at: Lattice, g: np.ndarray) -> np.ndarray:
        """Of the gaps after tokens ``g``, in order: the posterior of a boundary."""
        word = at.kind[g] == _WORD
        m, w = np.flatnonzero(~word), np.flatnonzero(word)
        beside = np.append(False, g[1:] == g[:-1] + 1)[: len(g)]
        joined = np.zeros(len(g))  # P(boundary), given that the gap before is none
        joined[m] = self.boundary(at.histories(g[m]))
        apart = joined.copy()  # given that it is one
        n = m[beside[m]]
        apart[n] = self.boundary(at.histories(g[n], after_boundary=True))
        if len(w):
            x = g[w]
            weight = np.where(at.plain[x], 1.0, self.unmarked)
            joined[w] = weight * self.boundary(at.word_histories(x, _shift(at.digest, at.cut)[x]))
            apart[w] = weight * self.boundary(at.word_histories(x, np.full(len(x), _BOUNDARY)))
        odds = self.follows(at.digest[g + 1], at.look[g + 1], _follower(at)[g + 1], word, at.digest[g])
        alone = joined * odds / (joined * odds + 1 - joined)
        other = apart * odds / (apart * odds + 1 - apart)
        likely = np.maximum(alone, other) > SLIGHT
        tied = beside & likely & np.append(False, likely[:-1])[: len(g)]
        begins = np.flatnonzero(tied & ~np.append(False, tied[:-1])) - 1
        ends = np.flatnonzero(tied & ~np.append(tied[1:], False))
        for a, z in zip(begins.tolist(), ends.tolist(), strict=True):
            alone[a : z + 1] = _forward_backward(joined[a : z + 1].tolist(), apart[a : z + 1].tolist(), odds[a : z + 1].tolist())
        return alone

    def spans(self, at: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sentences of a lattice: text, start and end in code points of the text."""
        g = np.flatnonzero(at.open & ((at.kind != _WORD) | at.plain | (self.unmarked > 0)))
        boundary = at.sure.copy()
        boundary[g[self.posteriors(at, g) > 0.5]] = True
        last = np.flatnonzero(boundary)
        first = np.flatnonzero(~at.stop & np.append(True, (boundary | at.stop)[:-1]))
        doc = at.doc[first]
        return doc, at.start[first] - at.base[doc], at.end[last] - at.base[doc]

    def needed(self, at: Lattice) -> np.ndarray:
        """Every key that ``spans`` looks up."""
        g = np.flatnonzero(at.open & ((at.kind != _WORD) | at.plain | (self.unmarked > 0)))
        m, w = g[at.kind[g] != _WORD], g[at.kind[g] == _WORD]
        n = _mix(at.digest[g + 1], _OF_NEXT)
        keys = [*at.histories(m), *at.histories(m, True), _mix(at.look[g + 1], _OF_NEXT_LOOK), n, _mix(n, _follower(at)[g + 1])]
        t = _mix(at.digest[w], _OF_NEXT)
        keys += [t, _mix(t, at.digest[w + 1]), *at.word_histories(w, _shift(at.digest, at.cut)[w]), *at.word_histories(w, np.full(len(w), _BOUNDARY))]
        return np.unique(np.concatenate(keys))


def _forward_backward(joined: list[float], apart: list[float], odds: list[float]) -> list[float]:
    """Posteriors of a chain of gaps, each in two states: a boundary, or none."""
    n = len(joined)
    ahead, scale = [(1 - joined[0], joined[0] * odds[0])], 1.0
    for i in range(1, n):
        none, one = ahead[-1]
        scale = none + one
        none, one = none / scale, one / scale
        ahead.append((none * (1 - joined[i]) + one * (1 - apart[i]), (none * joined[i] + one * apart[i]) * odds[i]))
    back = [(1.0, 1.0)]
    for i in range(n - 1, 0, -1):
        none, one = back[-1]
        x, y = (1 - joined[i]) * none + joined[i] * odds[i] * one, (1 - apart[i]) * none + apart[i] * odds[i] * one
        back.append((x / (x + y), y / (x + y)))
    back.reverse()
    return [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(ahead, back, strict=True)]


def _median(buckets: list[tuple[float, int]]) -> float:
    """The weighted median of (value, weight)."""
    total, seen = sum(n for _, n in buckets), 0
    for value, n in sorted(buckets):
        seen += n
        if 2 * seen >= total:
            return value
    return 0.0


def _totals(counts: DataFrame) -> dict[str, float]:
    """``r`` and the sums of the model, from the table of counts.

    A token that has begun x paragraphs follows marks inside paragraphs about r x times; tokens that do so for other reasons
    are on either side of the median. Ratios are taken in steps of a hundredth, so what comes to the driver is a short histogram.
    """
    total = {int(t["key"]): (t["a"], t["b"]) for t in counts.where(F.col("kind") == _TOTAL).collect()}
    marked, plain = total.get(int(_TOTAL_MARKED), (0, 0))[0], total.get(int(_TOTAL_PLAIN), (0, 0))[0]
    following = counts.where(F.col("kind") == _NEXT)
    begun, other, types = following.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0)), F.count(F.when(F.col("a") > 0, 1))).first()
    step = lambda c: F.when(F.col(c) > 0, F.round(F.log(F.col(c) / F.col("a")), 2))
    ratios = following.where("a > 0").select(F.explode(F.array(*[F.struct(F.lit(i).alias("of"), step(c).alias("ratio"), "a") for i, c in enumerate(("c", "d"))])).alias("x")).select("x.*")
    found = ratios.groupBy("of", "ratio").agg(F.sum("a").alias("n")).collect()
    r, r_plain = (_median([(0.0 if x["ratio"] is None else math.exp(x["ratio"]), x["n"]) for x in found if x["of"] == i]) * begun / max(n, 1) for i, n in enumerate((marked, plain)))
    unmarked = r_plain * plain / (r * marked + r_plain * plain) if r_plain * plain > 0 else 0.0
    return {"begun": begun, "other": other, "types": types, "r": max(r, 1e-6), "unmarked": unmarked}


def _is_ocr(source: str | None) -> bool:
    return source is not None and source.strip().lower() == "ocr_text"


_CUTS = {True: re.compile("[\n\r\v\f\x85\u2028\u2029]"), False: re.compile("(?:\r\n|[\n\r\v\f\x85\u2028\u2029])[^\\S\n\r]*[\n\r\v\f\x85\u2028\u2029]")}


def _lattices(texts: list[str], lines: list[bool], items: Items) -> Iterator[tuple[Lattice, np.ndarray, np.ndarray]]:
    """Lattices of some texts at a time, with the number of the text that each of their texts is from, and its place there. Long texts are parted where a sentence surely ends."""
    which: list[int] = []
    places: list[int] = []
    parts: list[str] = []
    size = 0

    def made() -> tuple[Lattice, np.ndarray, np.ndarray]:
        if len(items) > Items.MOST:
            items.__init__()
            items.clear()
        return Lattice(parts, [lines[i] for i in which], items), np.array(which), np.array(places)

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            cut = _CUTS[lines[i]].search(text, at + AT_ONCE) if len(text) - at > AT_ONCE else None
            to = cut.end() if cut else len(text)
            which.append(i)
            places.append(at)
            parts.append(text[at:to])
            size += to - at
            at = to
            if size >= AT_ONCE:
                yield made()
                which, places, parts, size = [], [], [], 0
    if parts:
        yield made()


def _texts(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    ocr = F.coalesce(F.lower(F.trim(F.regexp_replace(F.col(f"`{source}`").cast("string"), r"(?U)^\s+|\s+$", ""))) == "ocr_text", F.lit(False))
    return df.where(F.col(f"`{text}`") != "").select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), ocr.alias("l"))


_COLUMNS = ("a", "b", "c", "d")


def count_all(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The table of counts of all texts: ``kind, key, a, b, c, d``."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items()
        for batch in batches:
            for at, _, _ in _lattices(batch.column(1).to_pylist(), batch.column(2).to_pylist(), items):
                for kind, keys, columns in count(at):
                    zero = np.zeros(len(keys), np.int64)
                    whole = [np.asarray(x, np.int64) for x in columns] + [zero] * (len(_COLUMNS) - len(columns))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), *map(pa.array, whole)], names=["kind", "key", *_COLUMNS])

    found = rows.mapInArrow(tally, "kind tinyint, key long, a long, b long, c long, d long")
    return scratch.put(found.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in _COLUMNS]), "counts")


def _model(keys, a, b, totals: dict[str, float]) -> Model:
    keys = np.asarray(keys, np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Model(keys[order], np.asarray(a, float)[order], np.asarray(b, float)[order], totals)


def _decoded(keys: pa.Array, texts: list[str], lines: list[bool], items: Items, model: Model, with_text: bool) -> Iterator[pa.RecordBatch]:
    names = ["k", "start_char", "end_char"]
    for at, which, place in _lattices(texts, lines, items):
        part, start, end = model.spans(at)
        doc, start, end = which[part], start + place[part], end + place[part]
        columns = [keys.take(pa.array(doc)), pa.array(start), pa.array(end)]
        if with_text:
            columns.append(pa.array([texts[i][a:b] for i, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)], pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=names + ["sentence"] * with_text)


def split(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", with_text: bool = False, most_sent: int = MOST_SENT, scratch: Scratch | None = None) -> DataFrame:
    """``key, start_char, end_char`` (and ``sentence``, if asked for): a row for each sentence, in code points from 0, end exclusive.

    * Null, empty and blank texts have no sentences; repeated rows give repeated sentences.
    * Every character that isn't white space belongs to exactly one sentence.
    * A null source is not recognised text. Texts of any length are read whole.
    * A null key is kept. An empty table gives no rows. Other columns are never read.

    The counts are of ``df`` itself. They go to the workers if they have at most ``most_sent`` rows, else each document is
    joined with those it needs.
    """
    scratch = scratch or Scratch(df.sparkSession, "sentences")
    rows = _texts(df, key, text, source)
    counts = count_all(spread(rows, "k", "t"), scratch)
    totals = _totals(counts)
    known = counts.where(F.col("kind") != _TOTAL).select("key", "a", "b")
    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, start_char long, end_char long" + ", sentence string" * with_text
    if known.count() <= most_sent:
        sent = known.toPandas()
        shared = df.sparkSession.sparkContext.broadcast((sent["key"].to_numpy(), sent["a"].to_numpy(), sent["b"].to_numpy()))

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, items = _model(*shared.value, totals), Items()
            for batch in batches:
                yield from _decoded(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), items, model, with_text)

        return spread(rows, "k", "t").mapInArrow(decode, schema).withColumnRenamed("k", key)

    numbered = scratch.put(rows.withColumn("row", F.monotonically_increasing_id()), "texts")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, nothing = Items(), _model([], [], [], totals)
        for batch in batches:
            for row, t, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for at, _, _ in _lattices([t], [line], items):
                    keys = nothing.needed(at).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row)), pa.array(keys)], names=["row", "key"])

    def decode_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items()
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(3)[i].as_py() or []
                model = _model([x["key"] for x in own], [x["a"] for x in own], [x["b"] for x in own], totals)
                yield from _decoded(batch.column(0).slice(i, 1), [batch.column(1)[i].as_py()], [batch.column(2)[i].as_py()], items, model, with_text)

    asked = spread(numbered.select("row", "t", "l"), "row").mapInArrow(needed, "row long, key long").distinct()
    found = asked.join(known, "key").groupBy("row").agg(F.collect_list(F.struct("key", "a", "b")).alias("own"))
    return numbered.join(found, "row", "left").select("k", "t", "l", "own").mapInArrow(decode_own, schema).withColumnRenamed("k", key)
