"""Problem 7: token ids of every text by a tokenization automaton.

Byte-pair encoding is compiled into an automaton over tokens by one gadget per merge
(u, v) -> w, in order of rank. The automaton starts with one state and an arc for each
byte; a gadget

1. removes arc v from the state entered by u (the merge may not be skipped),
2. adds arc w to each state that still has arc u, and
3. gives w a state with the arcs that the state of v had before step 1.

The state entered by a token so depends on that token alone, and its arcs are inherited,
with a time stamp, from the states of its parts; ``Automaton.arc`` follows that
inheritance. Paths of the final automaton are exactly the encodings.

Encoding runs the automaton over bytes: its determinization (which tokens may be open,
and which token ends here) is built as it is needed and kept in a transition table.
Every prefix of a word has one encoding, so a state has one last token, and the ids are
read off backwards from the end of the word. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.runtime import spread

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: the pattern by which this family of byte-level encoders splits text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Table entries and words a worker keeps before it starts its tables afresh (results don't depend on it).
MOST_ENTRIES, MOST_WORDS = 2_000_000, 200_000
_START = -1


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where it is visible, else one from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], pattern: str = PATTERN):
        import regex

        letter = byte_letters()
        self.split = regex.compile(pattern).findall
        self.label: dict[int, bytes] = {}
        self.born: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.removed: dict[tuple[int, int], int] = {}
        for a, b in letter.items():
            self.label[vocabulary[a]] = bytes([b])
            self.born[vocabulary[a]] = -1
        for time, (a, b) in enumerate(merges):
            self._gadget(time, vocabulary[a], vocabulary[b], vocabulary[a + b])
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [_START]
        for token, text in self.label.items():
            node = 0
            for byte in text:
                after = self.trie[node].get(byte)
                if after is None:
                    after = self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(_START)
                node = after
            self.ends[node] = token
        self._clear()

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        self.removed[u, v] = time
        self.label[w], self.born[w], self.left[w], self.right[w] = self.label[u] + self.label[v], time, u, v

    def arc(self, p: int, t: int) -> bool:
        """Whether the state entered by token ``p`` has an arc for token ``t``."""
        before = 1 << 60
        while True:
            if self.removed.get((p, t), before) < before:
                return False
            if self.born[p] > self.born[t]:
                before, p = self.born[p], self.right[p]
            elif self.born[t] >= 0:
                before, t = self.born[t] + 1, self.left[t]
            else:
                return True

    def _clear(self) -> None:
        self.words: dict[str, list[int]] = {}
        self.table: dict[int, int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, int] = {}
        self.open: list[tuple] = []
        self.last: list[int] = []
        self.start = self._state(((0, _START),), _START)

    def _state(self, items: tuple, last: int) -> int:
        found = self.states.get((items, last))
        if found is None:
            found = self.states[items, last] = len(self.open)
            self.open.append(items)
            self.last.append(last)
        return found

    def _step(self, state: int, byte: int) -> int:
        items, last = [], _START
        for node, before in self.open[state]:
            after = self.trie[node].get(byte)
            if after is None:
                continue
            token = self.ends[after]
            if last == _START and token != _START:
                allowed = before == _START or self.arcs.get((before, token))
                if allowed is None:
                    allowed = self.arcs[before, token] = self.arc(before, token)
                if allowed:
                    last = token
            if self.trie[after]:
                items.append((after, before))
        items.append((0, last))
        to = self.table[state << 8 | byte] = self._state(tuple(items), last)
        return to

    def word(self, text: str) -> list[int]:
        ids = self.words.get(text)
        if ids is not None:
            return ids
        if len(self.table) > MOST_ENTRIES or len(self.words) > MOST_WORDS:
            self._clear()
        data, table, state, path = text.encode("utf-8", "surrogatepass"), self.table, self.start, []
        for byte in data:
            to = table.get(state << 8 | byte)
            state = self._step(state, byte) if to is None else to
            path.append(state)
        ids, at = [], len(data)
        while at:
            token = self.last[path[at - 1]]
            ids.append(token)
            at -= len(self.label[token])
        ids.reverse()
        if len(data) <= 64:
            self.words[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; none for null and empty text. Strings that look like special tokens are ordinary text."""
        out: list[int] = []
        for word in self.split(text or ""):
            out += self.word(word)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def compiled(vocabulary: str) -> Automaton:
    """The automaton of the contents of a byte-level vocabulary file, compiled once a process."""
    model = json.loads(vocabulary)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Automaton(model["vocab"], merges)


@lru_cache(maxsize=2)
def _contents(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def automaton(path: str = BYTE_BPE_50K) -> Automaton:
    return compiled(_contents(path))


def _over(df: DataFrame, columns: list[str], schema: str, path: str, make) -> DataFrame:
    """``make`` gives, for an automaton and the list of values of the last of ``columns``, an Arrow array; the others are passed on.

    The vocabulary file is read where the query is made and sent to the workers, a few megabytes of a fixed file.
    """
    shared = df.sparkSession.sparkContext.broadcast(_contents(path))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = compiled(shared.value)
        for batch in batches:
            made = make(auto, batch.column(len(columns) - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*columns[:-1], "made"])

    return spread(df.select(*[F.col(f"`{c}`") for c in columns]), *[f"`{c}`" for c in columns]).mapInArrow(apply, schema)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """``key, ids`` of every row, whole texts of any length.

    Null and empty texts have an empty list; blank texts have the ids of their white
    space. Repeated rows stay as many rows; an empty table gives none; other columns
    are never read.
    """
    kind = df.schema[key].dataType.simpleString()
    return _over(df, [key, text], f"`{key}` {kind}, made array<int>", path, lambda auto, texts: pa.array([auto.encode(t) for t in texts], pa.list_(pa.int32()))).withColumnRenamed("made", "ids")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """``*keep, tokens``: how many ids each text has."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return _over(df, [*keep, text], f"{kinds}, made long", path, lambda auto, texts: pa.array([len(auto.encode(t)) for t in texts], pa.int64())).withColumnRenamed("made", "tokens")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = BYTE_BPE_50K) -> DataFrame:
    """``key, text`` from ids; null and empty lists give an empty text."""
    kind = df.schema[key].dataType.simpleString()
    return _over(df, [key, ids], f"`{key}` {kind}, made string", path, lambda auto, lists: pa.array([auto.decode(i or ()) for i in lists], pa.string())).withColumnRenamed("made", "text")
