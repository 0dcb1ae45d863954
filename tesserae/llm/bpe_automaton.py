"""Byte-level BPE as a deterministic automaton over tokens.

Start from one state with an arc for every byte. A merge (u, v) -> w, in rank order, is a gadget: the state that u
leads to is copied without its arc v, u is redirected to the copy, and w is added beside every u, leading where v led.
After the last merge the automaton accepts exactly the tokenisations that the merges produce: after token t it is in
one state, and an arc x from there exists if and only if BPE can put x after t.

States share structure: a copy holds only its parent and the arc taken away, which makes 50,000 gadgets cheap. An arc
of the transition table is computed from these when it is first met (``allowed``) and read from the table from then on.

Encoding is deterministic, byte by byte, by two tables: the automaton's arcs, and the transitions over bytes of the
labels' suffix automaton, whose states know the labels that end at a byte. The automaton accepts one path for every
string, so for every prefix of a word exactly one label that ends there has an arc from the last label of the prefix
before it. The last labels, read back from the word's end, are its ids. Nothing is searched or taken back, and the work
is in proportion to the word. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from functools import lru_cache

import regex

#: Pre-tokeniser pattern of the vocabulary (fixed value).
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of a generation of the memo; two are held.
MEMO_WORDS = 400_000
MEMO_ARCS = 4_000_000
#: Bytes of a word's head, and how many heads are held.
HEAD = 4
MEMO_HEADS = 200_000


def byte_characters() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_characters()
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.label: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for piece, i in vocab.items():
            self.label[i] = bytes(of[c] for c in piece)
        for piece, i in self.special.items():
            self.label[i] = piece.encode()
        self.decimal = list(map(str, range(len(self.label))))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self._compile([(vocab[u], vocab[v], vocab[u + v]) for u, v in merges], [vocab[c] for c in of])
        self._split = regex.compile(PRE_SPLIT)
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._chunks: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def _compile(self, merges: list[tuple[int, int, int]], alphabet: list[int]) -> None:
        """Apply the merge gadgets. State 0 is the start; ``parent``/``taken``/``born`` describe each later copy."""
        n = len(self.label)
        self.parent, self.taken, self.born = [0], [-1], [-1]
        self.state = [0] * n  # where the arcs labelled t lead now
        self.left, self.rank = [-1] * n, [-1] * n  # of the merge that made t
        self.seen = [-1] * n  # the arc t was added to the states, as they were before this merge
        for rank, (u, v, w) in enumerate(merges):
            target = self.state[v]
            self.parent.append(self.state[u])
            self.taken.append(v)
            self.born.append(rank)
            self.state[u] = len(self.parent) - 1
            self.state[w] = target
            self.left[w], self.rank[w] = u, rank
            # a pair of equal labels is taken from the left, so the copy, without u, gets no w beside it
            self.seen[w] = rank + (u == v)
        self.arcs: dict[int, bool] = {}
        self.by_label = {self.label[t]: t for t in [*alphabet, *(m[2] for m in merges)]}
        self._compile_labels()

    def _compile_labels(self) -> None:
        """The suffix automaton of the labels: a tree of their bytes, for each node the longest proper suffix that is a
        node (``fail``), and the labels that end there with their sizes, the longest first (``ends``)."""
        tree: list[dict[int, int]] = [{}]
        ends: list[tuple] = [()]
        for x, t in self.by_label.items():
            at = 0
            for b in x:
                below = tree[at].get(b)
                if below is None:
                    below = tree[at][b] = len(tree)
                    tree.append({})
                    ends.append(())
                at = below
            ends[at] = ((t, len(x)),)
        fail = [0] * len(tree)
        level = list(tree[0].values())
        while level:
            deeper = []
            for at in level:
                ends[at] += ends[fail[at]]
                for b, below in tree[at].items():
                    up = fail[at]
                    while up and b not in tree[up]:
                        up = fail[up]
                    fail[below] = tree[up].get(b, 0) if at else 0
                    deeper.append(below)
            level = deeper
        self.tree, self.fail, self.ends = tree, fail, ends
        self.steps: dict[int, tuple[int, tuple]] = {}  # state << 8 | byte -> (state, ends)
        self.heads: dict[bytes, tuple[int, list[int]]] = {}  # state and last labels after the first bytes of words

    def allowed(self, state: int, token: int, before: int = 1 << 60) -> bool:
        """Whether ``state``, as it was before merge ``before``, has an arc ``token``."""
        while True:
            # the state of that time: copies made later are stepped back over
            while self.born[state] >= before:
                state = self.parent[state]
            s, made = state, self.rank[token]
            # taken away since the label exists?
            while s and self.born[s] > made:
                if self.taken[s] == token:
                    return False
                s = self.parent[s]
            if made < 0:
                return True
            # the gadget added it beside its left part: was that arc there then?
            state, token, before = s, self.left[token], self.seen[token]

    def arc(self, last: int, token: int) -> bool:
        """Whether the state after ``last`` has an arc ``token``: computed once, then in the table."""
        if len(self.arcs) >= MEMO_ARCS:
            self.arcs.clear()
        found = self.arcs[last << 17 | token] = self.allowed(self.state[last], token)
        return found

    def step(self, state: int, byte: int) -> tuple[int, tuple]:
        """The suffix automaton's transition over a byte, and the labels that end there: computed once, then in the table."""
        up = state
        while up and byte not in self.tree[up]:
            up = self.fail[up]
        to = self.tree[up].get(byte, 0)
        found = self.steps[state << 8 | byte] = (to, self.ends[to])
        return found

    def word(self, word: bytes) -> list[int]:
        """The ids of one pre-split word: the one path of the automaton whose labels spell it."""
        steps, arcs, label = self.steps, self.arcs, self.label
        head = word[:HEAD]
        known = self.heads.get(head)
        if known:  # many words begin alike
            state, last = known[0], known[1].copy()
            at, rest = HEAD, word[HEAD:]
        else:
            state, last, at, rest = 0, [-1], 0, word
        for byte in rest:
            at += 1
            state, ends = steps.get(state << 8 | byte) or self.step(state, byte)
            for token, size in ends:
                before = last[at - size]
                if before < 0:  # the label is the whole prefix
                    break
                open_ = arcs.get(before << 17 | token)
                if open_ or open_ is None and self.arc(before, token):
                    break
            last.append(token)
            if at == HEAD and not known:
                if len(self.heads) >= MEMO_HEADS:
                    self.heads.clear()
                self.heads[head] = (state, last.copy())
        ids = []
        while at:
            token = last[at]
            ids.append(token)
            at -= len(label[token])
        ids.reverse()
        return ids

    def chunk(self, text: str) -> tuple[int, ...]:
        """The ids of a text without special strings, by its pre-split words; short ones are remembered in two generations."""
        found = self._chunks.get(text)
        if found is None:
            found = self._older.get(text)
            if found is None:
                found = self._pieces(text)
            if len(text) <= 48:
                if len(self._chunks) >= MEMO_WORDS:
                    # words met again since the last turn are carried on, the rest is forgotten
                    self._older, self._chunks = self._chunks, {}
                self._chunks[text] = found
        return found

    def _pieces(self, text: str) -> tuple[int, ...]:
        """The ids by pre-split words. Plain words of Latin letters, also before one sign, need no pattern to be split."""
        last = text[-1]
        if last in SIGNS and len(text) > 1 and text[-2].isalpha():
            return (*self.chunk(text[:-1]), self.by_label[last.encode()])  # the pre-split always cuts after a letter there
        if max(text) < BEYOND_LATIN and (text[1:] if text[0] == " " else text).isalpha():
            return tuple(self.word(text.encode()))
        return tuple(i for piece in self._split.findall(text) for i in self.word(piece.encode()))

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; special strings in it become their ids."""
        ids: list[int] = []
        at = 0
        for found in self._special.finditer(text) if self._special else ():
            self._plain(text[at : found.start()], ids)
            ids.append(self.special[found.group()])
            at = found.end()
        self._plain(text[at:] if at else text, ids)
        return ids

    def _plain(self, text: str, ids: list[int]) -> None:
        if not text:
            return
        # between a non-space and a single space before a non-space the pre-split always cuts
        if loose_space(text):
            parts = SAFE_CUT.split(text)
        else:
            first, *parts = text.split(" ")
            if first:
                ids += self.chunk(first)
            chunk = self.chunk
            for p in parts:
                ids += self._chunks.get(s := " " + p) or chunk(s)
            return
        for p in parts:
            if p:
                ids += self.chunk(p)

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one after the other, as text (bytes that are no UTF-8 become U+FFFD)."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


#: Signs of one byte and label, none of which starts a contraction, and the first code point after the Latin letters.
SIGNS = ".,;:!?"
BEYOND_LATIN = "\u0250"
#: White space other than the space; every code point that Unicode counts so lies below this bound.
WHITE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")
SAFE_CUT = regex.compile(r"(?<=\S)(?= \S)")


def loose_space(text: str) -> bool:
    """Whether a space stands next to white space or at the end: then cuts are searched by pattern."""
    return text[-1] == " " or "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in WHITE)


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """The compiled automaton of a vocabulary file, once a process."""
    return Automaton(path)
