"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens: there is an arc from token u to token v if and only if v may follow u in the
encoding of some word, and a word has exactly one accepted path. It arises by applying one gadget for
each merge (a, b) -> c in order of rank, to an automaton in which any byte may follow any other:

* c gets the incoming arcs that a has at that time, and the outgoing arcs that b has;
* the arc from a to b goes; if a is b, the arc from a to c doesn't come, as merges go from left to right;
* c is reachable only if the arc from a to b is there and a and b are reachable.

Its 50,000 states have too many arcs to write down, so the table of arcs has a fixed number of slots, filled when an
arc is first asked for: it is traced back through the gadgets that created its ends. Encoding walks over the bytes of
many words at once; the state after each prefix is the last token of that prefix's encoding, and each step looks up
one transition for each word. Decoding emits the labels of the arcs that the ids name."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept
from .wordhash import groups

#: How a byte-level vocabulary splits text before merging (fixed by the vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as SPLIT has it. A split never joins what stands before white space to what follows, so a text may be cut there.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces of text that a worker remembers, and the longest that it does, in characters.
REMEMBER, MEMORABLE = 300_000, 48
#: Characters and rows that a task encodes at once.
TOGETHER, PASSED = 1 << 20, 256
#: Bits of the number of slots for arcs, words that are walked together, and the most bytes of such a word.
SLOT_BITS, WALKED, SHORT = 20, 8192, 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """A fixed map from non-negative int64 keys to int32 values that looks up whole arrays; -1 for other keys."""

    def __init__(self, found: dict[int, int]):
        self.bits = max(8, int(4 * len(found)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys, values = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            left = self.keys[at] != keys  # taken, or another key of this turn came last
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _ODD >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((got != keys) & (got >= 0))
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1) if len(at) == len(open_) else (at[open_] + 1) & ((1 << self.bits) - 1)
            want, got = keys[open_], self.keys[at]
            hit = got == want
            out[open_[hit]] = self.values[at[hit]]
            go = ~hit & (got >= 0)
            open_, at = open_[go], at[go]
        return out


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: printable bytes stand for
    themselves, the others follow from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Automaton:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_alphabet()
        raw = lambda t: bytes(letters[c] for c in t)
        self.label = {i: raw(t) for t, i in vocabulary.items() if t not in special} | {i: t.encode() for t, i in special.items()}
        self.special = special
        self.rank: dict[tuple[int, int], int] = {}  # of merges
        self.born: dict[int, int] = {}  # the rank of the gadget that made a token; bytes: -1
        self.parts: dict[int, tuple[int, int]] = {}
        self.table: dict[int, bool] = {}  # arcs that are known
        self.token: dict[bytes, int] = {}
        made = {i for t, i in vocabulary.items() if len(t) == 1 and t in letters}
        for i in made:
            self.born[i] = -1
            self.token[self.label[i]] = i
        for k, (left, right) in enumerate(merges):
            a, b, c = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.rank[a, b] = k
            if c not in self.born and a in self.born and b in self.born and self.arc(a, b, k - 1):
                self.born[c], self.parts[c] = k, (a, b)
                self.token[self.label[c]] = c
        self.always = len(merges)
        # a trie of reversed labels: node * 256 + byte to node, and the token of each node
        self.back: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for label, i in self.token.items():
            node = 0
            for byte in reversed(label):
                node = self.back.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = i
        self.size = max(self.label) + 1
        # the same as arrays, for many words at once
        self.steps, self.end_tokens = Table(self.back), np.array(self.ends, np.int32)
        self.ranks = Table({a * self.size + b: k for (a, b), k in self.rank.items()})
        self.births, self.halves = np.full(self.size, -1, np.int64), np.zeros((2, self.size), np.int64)
        for c, (a, b) in self.parts.items():
            self.births[c], self.halves[:, c] = self.born[c], (a, b)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int64)  # 2 * key, and 1 if there is the arc
        self.names = [str(i) for i in range(self.size)]

    def arc(self, u: int, v: int, after: int) -> bool:
        """Whether v may follow u once the gadgets up to rank `after` are applied."""
        while True:
            if self.rank.get((u, v), after + 1) <= after:
                return False
            bu, bv = self.born[u], self.born[v]
            if bu < 0 and bv < 0:
                return True
            if bv > bu:
                left, right = self.parts[v]
                if left == right == u:
                    return False
                v, after = left, bv - 1
            else:
                # u is younger, or both are the same token, whose gadget joins its right part to its left one
                after = bu - 1
                if bu == bv:
                    u, v = self.parts[u][1], self.parts[v][0]
                else:
                    u = self.parts[u][1]

    def encode_word(self, word: bytes) -> list[int]:
        """The token ids of one pre-split word: the only accepted path."""
        n = len(word)
        last, start = [0] * (n + 1), [0] * (n + 1)
        back, ends, table, size = self.back, self.ends, self.table, self.size
        for end in range(1, n + 1):
            node, at = 0, end
            while at:
                at -= 1
                node = back.get(node << 8 | word[at])
                if node is None:
                    raise ValueError(f"no accepted path for {word!r}")
                t = ends[node]
                if t < 0:
                    continue
                if at:
                    key = last[at] * size + t
                    known = table.get(key)
                    if known is None:
                        if len(table) >= 1 << SLOT_BITS - 4:
                            table.clear()
                        known = table[key] = self.arc(last[at], t, self.always)
                    if not known:
                        continue
                last[end], start[end] = t, at
                break
        out, end = [], n
        while end:
            out.append(last[end])
            end = start[end]
        return out[::-1]

    def arcs(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Which arcs the finished automaton has, from the table."""
        key = u.astype(np.int64) * self.size + v
        at = (key.astype(np.uint64) * _ODD >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        got = self.slots[at]
        new = np.flatnonzero(got >> 1 != key)
        if len(new):
            got[new] = key[new] << 1 | self._traced(u[new].astype(np.int64), v[new].astype(np.int64))
            self.slots[at[new]] = got[new]
        return (got & 1).astype(bool)

    def _traced(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """arc() of many pairs at once."""
        out, live, after = np.zeros(len(u), bool), np.arange(len(u)), np.full(len(u), self.always)
        while len(live):
            rank = self.ranks[u * self.size + v]
            old_u, old_v = self.births[u], self.births[v]
            gone, bytes_ = (rank >= 0) & (rank <= after), (old_u < 0) & (old_v < 0)
            out[live[bytes_ & ~gone]] = True
            (left, right), younger = self.halves[:, v], old_v > old_u
            go = ~(gone | bytes_ | (younger & (left == u) & (right == u)))
            next_u = np.where(younger, u, self.halves[1, u])
            next_v = np.where(younger | (old_u == old_v), left, v)
            after = np.where(younger, old_v, old_u) - 1
            live, u, v, after = live[go], next_u[go], next_v[go], after[go]
        return out

    def encode_words(self, words: list[bytes]) -> list[str]:
        """The token ids, joined by commas, of pre-split words, of which none is empty."""
        size = np.array([len(w) for w in words], np.int64)
        out = [""] * len(words)
        order = np.argsort(size, kind="stable")
        short = int(np.searchsorted(size[order], SHORT, "right"))
        for first in range(0, short, WALKED):
            some = order[first : min(short, first + WALKED)].tolist()
            for k, ids in zip(some, self._walked([words[k] for k in some], size[some]), strict=True):
                out[k] = ids
        for k in order[short:].tolist():
            out[k] = ",".join(map(str, self.encode_word(words[k])))
        return out

    def _walked(self, words: list[bytes], size: np.ndarray) -> list[str]:
        """words in order of their sizes."""
        n = int(size[-1])
        text = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in words), np.uint8).reshape(len(words), n)
        last, start = np.zeros((2, n + 1, len(words)), np.int32)
        for end in range(1, n + 1):
            live = np.arange(np.searchsorted(size, end), len(words))
            node = np.zeros(len(live), np.int64)
            for at in range(end - 1, -1, -1):
                node = self.steps[node << 8 | text[live, at]].astype(np.int64)
                if (node < 0).any():
                    break
                t = self.end_tokens[node]
                ok = t >= 0
                if at:
                    some = np.flatnonzero(ok)
                    ok[some] = self.arcs(last[at, live[some]], t[some])
                last[end, live[ok]], start[end, live[ok]] = t[ok], at
                live, node = live[~ok], node[~ok]
                if not len(live):
                    break
            if len(live):
                raise ValueError(f"no accepted path for {words[live[0]]!r}")
        path, live, at = np.full((len(words), n + 1), -1, np.int32), np.arange(len(words)), size
        while len(live):
            path[live, at] = last[at, live]
            at = start[at, live]
            live, at = live[at > 0], at[at > 0]
        met = path >= 0
        ids, ends = [self.names[i] for i in path[met].tolist()], np.cumsum(met.sum(axis=1)).tolist()
        return [",".join(ids[i:j]) for i, j in zip([0, *ends], ends)]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs that the ids name, one after the other."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """Splits texts and remembers the encodings of short pieces that it met lately; one for each worker process."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.new: dict[str, str] = {}  # piece to its ids, joined by commas
        self.old: dict[str, str] = {}
        self.labels = {str(i): label for i, label in automaton.label.items()}
        self.pieces, self.split = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall, regex.compile(SPLIT).findall
        self.special = re.compile("|".join(map(re.escape, sorted(automaton.special, key=len, reverse=True)))) if automaton.special else None

    def cut(self, text: str) -> list[str]:
        """The text in pieces, each white space with what follows; strings of special tokens stand alone."""
        if self.special is None or not self.special.search(text):
            return self.pieces(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.pieces(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.pieces(text[at:])

    def _known(self, pieces: set[str]) -> dict[str, str]:
        """The ids of the pieces, joined by commas. The words of those that neither generation remembers are walked together."""
        a, known, missing = self.automaton, {}, []
        for p in pieces.difference(self.new):
            if p in self.old:
                known[p] = self.old[p]
            elif p in a.special:
                known[p] = a.names[a.special[p]]
            else:
                missing.append((p, self.split(p)))
        words = list({w for _, ws in missing for w in ws})
        ids = dict(zip(words, a.encode_words([w.encode("utf-8", "surrogatepass") for w in words]), strict=True))
        for p, ws in missing:
            known[p] = ids[p] if len(ws) == 1 else ",".join([ids[w] for w in ws])
        if len(self.new) + len(known) > REMEMBER // 2:
            known |= {p: self.new[p] for p in pieces.intersection(self.new)}
            self.old, self.new = self.new, {}
        self.new.update((p, i) for p, i in known.items() if len(p) <= MEMORABLE)
        return known if len(known) == len(pieces) else self.new | known if any(len(p) > MEMORABLE for p in known) else self.new

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encoded([text])[0].split(",") if i]

    def encoded(self, texts: list[str | None]) -> list[str]:
        """The ids of each text, joined by commas."""
        pieces = [self.cut(t or "") for t in texts]
        known = self._known(set().union(*pieces))
        return [",".join([known[p] for p in some]) for some in pieces]

    def decoded(self, ids: str) -> str:
        """The text of ids joined by commas."""
        return b"".join(map(self.labels.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


def load(path: str) -> Automaton:
    """From a byte-level BPE file in the JSON format of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in d["model"]["merges"]]
    special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
    return Automaton(d["model"]["vocab"], merges, special)


def _encoder(name: str) -> Encoder:
    return kept(f"bpe {name}", lambda: Encoder(load(SparkFiles.get(name))))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 and, if ids, the array `ids`.

    vocabulary: path of the file on the driver; Spark ships it to the executors. Null and empty texts have
    no tokens. Whole texts are encoded, then decoded from their ids; strings of special tokens in a text
    become those tokens, as in the library. Very long words are walked once and not remembered. Rows that repeat
    an id, or have none, are encoded each by itself. Of an empty table nothing comes. Other columns are ignored."""
    spark, name = docs.sparkSession, vocabulary.rpartition("/")[2]
    spark.sparkContext.addFile(vocabulary)
    fields = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in groups(texts, TOGETHER, PASSED):
                got = encoder.encoded(texts[i:j])
                sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
                out = [b.column("id").slice(i, j - i), pa.array([g.count(",") + bool(g) for g in got], pa.int64()), pa.array(map(sha, got), pa.string()), pa.array([sha(encoder.decoded(g)) for g in got], pa.string())]
                if ids:
                    out.append(pa.array([np.array(g.split(","), np.int32) if g else np.zeros(0, np.int32) for g in got], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, fields).withColumnRenamed("id", id_col)
