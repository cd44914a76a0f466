"""BPE encoding and decoding by an automaton over tokens.

Method. The merges are compiled one after another into a deterministic automaton whose
arcs are labelled with tokens: it starts with one state that has a loop for every base
symbol, and the gadget of merge (u, v) adds an arc ``uv`` wherever ``u`` may be read and
takes the arc ``v`` away from the state reached by ``u`` (a copy of it, where other tokens
reach it too). For each string of base symbols exactly one path remains, and its labels
are the string's BPE tokens. All arcs with one label lead to one state, so the automaton is
kept as three tables: the state of each token, the arcs withdrawn from each state with the
time they were withdrawn, and for each token the merge (time, left part) that made its arc.
An arc that a later gadget copies depends on the arc of its left part at that time, so an
arc is present if neither it nor, at those times, its left parts were withdrawn; every
answer is entered in a transition table. The unseen words of a batch are encoded together:
position by position, the states of all words take their transitions as array gathers, until
every prefix has the arc that ends its only path. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_BYTES = 48 << 20  # of words remembered per worker in each of two generations
ENTRY_BYTES = 300  # of a remembered word beside its characters
CACHE_ARCS = 250_000  # transitions remembered per worker for words run one by one
ARC_SLOTS = 1 << 20  # of the transition table for words run together
TOGETHER = 48  # bytes of the longest word that is run together with others
WORDS = 1 << 16  # run together at a time
ROWS = 500  # encoded at a time
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # odd factor that spreads keys over slots


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte used by byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others follow from code point 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class TokenAutomaton:
    """The compiled merges of one vocabulary file."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.labels: dict[int, str] = {i: t for t, i in vocab.items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels |= {i: t for t, i in self.special.items()}
        self.symbols = byte_symbols()
        size = max(self.labels) + 1
        # made[token] = (time, left part) of the merge that made its arc.
        self.made: list[tuple[int, int] | None] = [None] * size
        # withdrawn[state] = {token: time}; state 0 is the start and is never changed.
        self.withdrawn: list[dict[int, int]] = [{}]
        self.state = [0] * size
        self.arcs: dict[int, bool] = {}
        readers = [0] * size  # tokens that lead to a state
        for i in vocab.values():
            if i < size:
                readers[0] += 1
        owners = {0: readers[0] + 1}
        pieces = []
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pieces.append((vocab[left], vocab[right], vocab[left + right]))
        for time, (u, v, uv) in enumerate(pieces):
            if not self.present(self.state[u], v):
                continue  # u is never followed by v: earlier merges leave no such place
            target = self.state[v]
            if self.made[uv] is None:
                self._point(uv, target, owners)
                self.made[uv] = (time, u)
            # Gadget: after u, v may no longer be read.
            p = self.state[u]
            if owners[p] > 1:
                self.withdrawn.append(dict(self.withdrawn[p]))
                copy = len(self.withdrawn) - 1
                owners[copy] = 0
                self._point(u, copy, owners)
                p = copy
            self.withdrawn[p].setdefault(v, time)
        self.width = size
        self.trie: dict = {}
        for token, label in self._base_labels(vocab).items():
            node = self.trie
            for symbol in label:
                node = node.setdefault(symbol, {})
            node[""] = token
        self._lay_out()
        self.state_array = np.array(self.state, dtype=np.int64)
        self.arc_keys = np.full(ARC_SLOTS, -1, dtype=np.int64)
        self.arc_values = np.zeros(ARC_SLOTS, dtype=bool)

    def _lay_out(self) -> None:
        """The prefix tree of the labels as arrays: a hash table of (node, symbol) and the
        token of each node. A byte that ends its word is a symbol of its own (256 more)."""
        code = {s: b for b, s in enumerate(self.symbols)}
        if self.suffix:
            code |= {s + self.suffix: b + 256 for b, s in enumerate(self.symbols)}
        tokens, edges, todo = [-1], [], [(0, self.trie)]
        while todo:
            at, node = todo.pop()
            for symbol, child in node.items():
                if symbol == "":
                    tokens[at] = child
                elif symbol in code:
                    edges.append((at * 512 + code[symbol], len(tokens)))
                    todo.append((len(tokens), child))
                    tokens.append(-1)
        self.token_of = np.array(tokens, dtype=np.int64)
        self.tree_shift = np.uint64(64 - max(1, (4 * len(edges)).bit_length()))
        size = 1 << (64 - int(self.tree_shift))
        self.tree_keys = np.full(size, -1, dtype=np.int64)
        self.tree_children = np.full(size, -1, dtype=np.int64)
        keys = np.array([k for k, _ in edges], dtype=np.int64)
        for slot, (key, child) in zip(self._slots(keys, self.tree_shift).tolist(), edges, strict=True):
            while self.tree_keys[slot] >= 0:
                slot = (slot + 1) % size
            self.tree_keys[slot] = key
            self.tree_children[slot] = child

    @staticmethod
    def _slots(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
        return ((keys.astype(np.uint64) * SPREAD) >> shift).astype(np.int64)

    def children(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Children of nodes in the prefix tree; -1 where there is none."""
        keys = nodes * 512 + symbols
        slots = self._slots(keys, self.tree_shift)
        held = self.tree_keys[slots]
        out = np.where(held == keys, self.tree_children[slots], -1)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while rest.size:
            slots[rest] = (slots[rest] + 1) % len(self.tree_keys)
            held = self.tree_keys[slots[rest]]
            same = held == keys[rest]
            out[rest[same]] = self.tree_children[slots[rest[same]]]
            rest = rest[~same & (held >= 0)]
        return out

    def have_arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Which arcs are there, by the transition table; an arc that it does not hold is
        worked out and takes its slot."""
        keys = states * self.width + tokens
        slots = self._slots(keys, np.uint64(64 - (ARC_SLOTS - 1).bit_length()))
        out = self.arc_values[slots]
        missed = np.flatnonzero(self.arc_keys[slots] != keys)
        if missed.size:
            new, where = np.unique(keys[missed], return_inverse=True)
            found = np.array([self.present(*divmod(k, self.width)) for k in new.tolist()], dtype=bool)
            out[missed] = found[where]
            self.arc_keys[slots[missed]] = keys[missed]
            # Of keys with one slot the last stays; its value must be its own.
            self.arc_values[slots[missed]] = out[missed]
        return out

    def _point(self, token: int, state: int, owners: dict[int, int]) -> None:
        owners[self.state[token]] -= 1
        self.state[token] = state
        owners[state] = owners.get(state, 0) + 1

    def _base_labels(self, vocab: dict[str, int]) -> dict[int, list[str]]:
        """Labels as base symbols: the word end is part of the last one."""
        mark = self.suffix
        out = {}
        made = self.made
        for label, token in vocab.items():
            if made[token] is None and len(label.removesuffix(mark) if mark else label) != 1:
                continue  # not a base symbol and made by no merge
            if mark and label.endswith(mark) and label != mark:
                body = label[: -len(mark)]
                out[token] = [*body[:-1], body[-1] + mark]
            else:
                out[token] = list(label)
        return out

    def present(self, state: int, token: int) -> bool:
        """Is there an arc: was neither it nor, when it was copied from them, its left parts
        withdrawn?"""
        gone = self.withdrawn[state]
        limit, x = len(self.made) * 2, token
        while True:
            at = gone.get(x)
            if at is not None and at <= limit:
                return False
            source = self.made[x]
            if source is None:
                return True
            limit, x = source

    def has_arc(self, state: int, token: int) -> bool:
        """Transition table, filled on first use."""
        key = state * self.width + token
        found = self.arcs.get(key)
        if found is None:
            found = self.present(state, token)
            if len(self.arcs) >= CACHE_ARCS:
                self.arcs.clear()
            self.arcs[key] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        """The labels of the only path that spells a word (text, not yet bytes)."""
        symbols = [self.symbols[b] for b in word.encode("utf-8")]
        if not symbols:
            return []
        symbols[-1] += self.suffix
        n = len(symbols)
        # Depth first, longest arc first. A prefix has one path only, so a position that
        # was reached once and led nowhere never needs a second look.
        reached: list[tuple[int, int] | None] = [None] * (n + 1)
        reached[0] = (-1, -1)
        todo = [0]
        state_of, trie, has_arc = self.state, self.trie, self.has_arc
        while todo and reached[n] is None:
            i = todo.pop()
            state = state_of[reached[i][0]] if i else 0
            node, j, ends = trie, i, []
            while j < n:
                node = node.get(symbols[j])
                if node is None:
                    break
                j += 1
                token = node.get("")
                if token is not None and reached[j] is None:
                    ends.append((token, j))
            for token, j in ends:  # the last one pushed, the longest, is taken first
                if has_arc(state, token):
                    reached[j] = (token, i)
                    todo.append(j)
        out, j = [], n
        while j:
            token, j = reached[j]
            out.append(token)
        return out[::-1]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """``encode_word`` of many words, short ones together and long ones one by one."""
        out: list[list[int]] = [[]] * len(words)
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        for i in np.flatnonzero(sizes > TOGETHER).tolist():
            out[i] = self.encode_word(words[i])
        short = np.flatnonzero((sizes <= TOGETHER) & (sizes > 0))
        for first in range(0, len(short), WORDS):
            part = short[first : first + WORDS]
            part = part[np.argsort(-sizes[part], kind="stable")]
            picked = part.tolist()
            for i, ids in zip(picked, self._run_together([raw[i] for i in picked], sizes[part]), strict=True):
                out[i] = ids
        return out

    def _run_together(self, raw: list[bytes], sizes: np.ndarray) -> list[list[int]]:
        """Words by falling length: the words that have a symbol at a position come first."""
        n, longest = len(raw), int(sizes[0])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        counts = np.searchsorted(-sizes, -np.arange(longest + 1), side="left")  # words longer than that
        symbols = []
        for at in range(longest):
            row = data[starts[: counts[at]] + at].astype(np.int64)
            if self.suffix:
                row[counts[at + 1] :] += 256
            symbols.append(row)
        last = np.full((longest + 1, n), -1, dtype=np.int64)  # token that ends a prefix
        origin = np.zeros((longest + 1, n), dtype=np.int8)  # where that token starts
        for at in range(longest):
            if at:
                picked = np.flatnonzero(last[at, : counts[at]] >= 0)
                states = self.state_array[last[at, picked]]
            else:
                picked = np.arange(n)
                states = np.zeros(n, dtype=np.int64)
            nodes = np.zeros(len(picked), dtype=np.int64)
            end = at
            while picked.size and end < longest:
                longer = int(np.searchsorted(picked, counts[end]))
                picked, states = picked[:longer], states[:longer]
                nodes = self.children(nodes[:longer], symbols[end][picked])
                more = nodes >= 0
                picked, states, nodes = picked[more], states[more], nodes[more]
                end += 1
                tokens = self.token_of[nodes]
                ends = np.flatnonzero((tokens >= 0) & (last[end, picked] < 0))
                ends = ends[self.have_arcs(states[ends], tokens[ends])]
                last[end, picked[ends]] = tokens[ends]
                origin[end, picked[ends]] = at
        # Walk the paths back from the word ends, all words a step at a time.
        words, at, steps = np.arange(n), sizes.copy(), []
        while words.size:
            ids = last[at, words]
            steps.append((words, ids))
            at = origin[at, words].astype(np.int64)
            more = at > 0
            words, at = words[more], at[more]
        owner = np.concatenate([w for w, _ in steps])
        ids = np.concatenate([t for _, t in steps])
        turn = np.repeat(np.arange(len(steps)), [len(w) for w, _ in steps])
        order = np.lexsort((-turn, owner))
        flat = ids[order].tolist()
        ends = np.cumsum(np.bincount(owner, minlength=n)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: list[int]) -> str:
        """Arc labels joined by one space, as a file without a decoder prescribes."""
        return " ".join(self.labels[i] for i in ids)


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout"):
        raise ValueError("a byte-level BPE file is expected")
    return spec


# White space for str.split but not for the files' patterns (fixed values).
NOT_SPACE = regex.compile("[\x1c-\x1f]")


def lowered(text: str) -> str:
    """Lower case letter by letter, without the rule for a sigma at a word's end."""
    if "Σ" in text:
        return "".join(c if c == "Σ" else c.lower() for c in text).replace("Σ", "σ")
    return text.lower()


def normalized(text: str) -> str:
    """Composed and lower case; runs of white space need no change, as no word holds any."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return lowered(text)


def class_ranges(kind: str, last: int = sys.maxunicode) -> str:
    """A character class as ranges by Python's Unicode tables, up to a code point.

    The pattern library's tables are newer and count as letters what the vocabulary
    files' own library does not know yet.
    """
    points = [c for c in range(last + 1) if unicodedata.category(chr(c))[0] == kind]
    out, first = [], 0
    for i in range(1, len(points) + 1):
        if i == len(points) or points[i] != points[i - 1] + 1:
            out.append(rf"\U{points[first]:08x}-\U{points[i - 1]:08x}")
            first = i
    return "".join(out)


Part = tuple[int, str, str]  # tokens, ids, labels


class Encoder:
    """Normalises, splits into words and encodes; remembers what it has seen.

    Words never hold white space, so whole runs of other characters are remembered. The
    memory has two generations, each bounded in bytes (and one call's runs): when the young
    one is full it becomes the old one, and frequent runs move back on their next use.
    """

    def __init__(self, spec: dict) -> None:
        self.automaton = TokenAutomaton(spec)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        pattern = simple = split["pattern"]["Regex"]
        for kind in "LN":
            pattern = pattern.replace(rf"\p{{{kind}}}", class_ranges(kind))
            simple = simple.replace(rf"\p{{{kind}}}", class_ranges(kind, 0x7F))
        self.words = regex.compile(pattern).findall
        self.ascii_words = regex.compile(simple).findall  # the same on ASCII, with short classes
        special = self.automaton.special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.numbers = {i: str(i) for i in self.automaton.labels}
        self.young: dict[str, Part] = {}
        self.old: dict[str, Part] = {}
        self.held = 0

    def learn(self, runs: set[str]) -> None:
        """Enters runs without white space that are not remembered yet."""
        if self.held >= CACHE_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        new = []
        for run in runs:
            if run not in young:
                found = old.get(run)
                if found is None:
                    new.append(run)
                else:
                    young[run] = found
                    self.held += ENTRY_BYTES + len(run) + len(found[1]) + len(found[2])
        words, owners = [], []
        for i, run in enumerate(new):
            if run.isalpha():
                words.append(run)
                owners.append(i)
            else:
                cut = self.ascii_words(run) if run.isascii() else self.words(run)
                words += cut
                owners += [i] * len(cut)
        ids_of: list[list[int]] = [[]] * len(new)
        for i, ids in zip(owners, self.automaton.encode_words(words), strict=True):
            ids_of[i] = ids_of[i] + ids if ids_of[i] else ids
        labels, numbers = self.automaton.labels, self.numbers
        for run, ids in zip(new, ids_of, strict=True):
            a, b = " ".join([numbers[i] for i in ids]), " ".join([labels[i] for i in ids])
            young[run] = (len(ids), a, b)
            self.held += ENTRY_BYTES + len(run) + len(a) + len(b)

    def runs(self, text: str) -> list[str]:
        text = normalized(text)
        return self.words(text) if NOT_SPACE.search(text) else text.split()

    def cut_up(self, text: str) -> list[str | Part]:
        """Runs of a text in order; added tokens as finished parts."""
        special = self.automaton.special
        if self.cut is None or not any(s in text for s in special):
            return self.runs(text)
        out: list[str | Part] = []
        for piece in self.cut.split(text):
            if piece in special:
                out.append((1, str(special[piece]), piece))
            elif piece:
                out += self.runs(piece)
        return out

    def parts(self, texts: list[str]) -> Iterator[list[Part]]:
        """(tokens, ids, labels) of every run in order, for each text; runs without tokens
        are left out."""
        cut = [self.cut_up(t) for t in texts]
        self.learn({r for runs in cut for r in runs if type(r) is str})
        young = self.young
        for runs in cut:
            found = [r if type(r) is tuple else young[r] for r in runs]
            yield [p for p in found if p[0]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in next(self.parts([text])) for i in p[1].split(" ")]


OUTPUT = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
    ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string()),
])


def encoded(batch: pa.RecordBatch, encoder: Encoder, keep: bool) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(6 if keep else 4)]
    for parts in encoder.parts([text or "" for text in batch.column("text").to_pylist()]):
        ids = " ".join([p[1] for p in parts])
        decoded = " ".join([p[2] for p in parts])
        columns[1].append(sum([p[0] for p in parts]))
        columns[2].append(hashlib.sha256(ids.encode()).hexdigest())
        columns[3].append(hashlib.sha256(decoded.encode()).hexdigest())
        if keep:
            columns[4].append(np.array(ids.split(), dtype=np.int32))
            columns[5].append(decoded)
    arrays = [batch.column("doc_id").cast(pa.int64())]
    arrays += [pa.array(c, OUTPUT.field(i + 1).type) for i, c in enumerate(columns[1:])]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(list(OUTPUT)[: len(arrays)]))


def encoding_task(encoder_of: Callable[[], Encoder], keep: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            if encoder is None:
                encoder = encoder_of()
            for first in range(0, max(whole.num_rows, 1), ROWS):
                yield encoded(whole.slice(first, ROWS), encoder, keep)

    return run


def worker_encoder(spec: dict) -> Encoder:
    """The encoder of a broadcast file; a worker process compiles it once and keeps it there."""
    if "encoder" not in spec:
        spec["encoder"] = Encoder(spec)
        del spec["model"]
    return spec["encoder"]


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_encode(docs: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """Encode ``text`` of every row and decode it again.

    Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256
    and, with ``keep``, ids and decoded. ``path`` is a tokenizer file on the driver; its
    content is broadcast (its size is the vocabulary's). Null text counts as empty: no
    tokens and the digests of an empty string. Rows are independent: repeated ids and rows
    stay, an empty table gives an empty result, other columns are ignored. Nothing is
    shuffled; memory is one Arrow batch and the word memory of twice ``CACHE_BYTES``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_spec(path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = DIGESTS + (", ids array<int>, decoded string" if keep else "")
    return rows.mapInArrow(encoding_task(lambda: worker_encoder(shared.value), keep), schema)
