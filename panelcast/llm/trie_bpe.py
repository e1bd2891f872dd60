"""BPE encoding of words by walking a trie of them.

The encoding of a string ends in exactly one token that can stand after the encoding of
what comes before it.  So the state of a trie node is its last token; going down, the
last token of a node follows from the states above it, and the encoding of a prefix that
many words share is found once.  The tokens that a node's string ends in are found from
the longest such end that begins a token, which a letter more changes in one step.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame

from panelcast.llm.common import distinct, joined, narrow, no_cycles, per_document

END = "</w>"
NEVER = 1 << 60
# White space as the tokenizer's patterns see it; ``str.split()`` also cuts at \x1c-\x1f.
SPACE = "\t-\r \x85\xa0  -     　"
MEMO = 600_000
TRIE_WORDS = 20_000
STOPS = ".,;:!?"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """Vocabulary and merge order, and which tokens can stand side by side."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.parts = {a + b: (a, b, i) for i, (a, b) in enumerate(pairs)}
        stems = {t.removesuffix(END) for t in self.ids}
        self.heads = {t[:i] for t in stems for i in range(1, len(t) + 1)}
        self.after: dict[str, str] = {}
        self.ends: dict[str, tuple[str, ...]] = {}
        self.marked_ends: dict[str, tuple[str, ...]] = {}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.edges: dict[tuple[str, bool], list[tuple[str, int]]] = {}
        self.whole: dict[str, bool | None] = dict.fromkeys(self.ids)  # None: not looked at yet
        self.codes = {t: i.to_bytes(4, "little") for t, i in self.ids.items()}
        self.met: dict[tuple[str, str], bool] = {}

    def edge(self, token: str, right: bool) -> list[tuple[str, int]]:
        """What stands at the token's edge while it grows, and the rank that ends it."""
        key = (token, right)
        found = self.edges.get(key)
        if found is None:
            steps, at, until = [], token, NEVER
            while True:
                steps.append((at, until))
                if at not in self.parts:
                    break
                left_part, right_part, until = self.parts[at]
                at = right_part if right else left_part
            found = self.edges[key] = steps[::-1]
        return found

    def beside(self, a: str, b: str) -> bool:
        """Whether no merge joins the two while both are being built."""
        found = self.met.get((a, b))
        if found is None:
            if len(self.met) >= MEMO:
                self.met.clear()
            found = self.met[a, b] = self._part(self.edge(a, True), self.edge(b, False)) is None
        return found

    def _part(self, left, right) -> tuple[int, bool] | None:
        """The merge that joins two growing tokens: its rank, and whether both are grown."""
        rank, i, j = self.rank, 0, 0
        while True:
            x, ends_x = left[i]
            y, ends_y = right[j]
            joins = rank.get((x, y))
            # Of equal ranks the leftmost merge comes first.
            if joins is not None and joins < ends_x and joins <= ends_y:
                return joins, ends_x == ends_y == NEVER
            if ends_x <= ends_y:
                i += 1
                if i == len(left):
                    return None
            else:
                j += 1

    def step(self, text: str) -> str:
        """The longest end of ``text`` that begins a token."""
        head = text
        while head and head not in self.heads:
            head = head[1:]
        self.after[text] = head
        return head

    def tokens_at(self, head: str, mark: str) -> tuple[str, ...]:
        """The tokens that a string ends in, longest first, by its end that begins one."""
        kept = self.marked_ends if mark else self.ends
        ends = (head[i:] + mark for i in range(len(head)))
        kept[head] = found = tuple(t for t in ends if self.is_token(t))
        return found

    def is_token(self, t: str) -> bool:
        """In the vocabulary and the encoding of its own letters."""
        found = self.whole.get(t, False)
        if found is None:
            found = self.whole[t] = t not in self.parts or self._builds(*self.parts[t])
        return found

    def _builds(self, a: str, b: str, rank: int) -> bool:
        """Both halves are tokens and their first merge is that of the whole."""
        if not (self.is_token(a) and self.is_token(b)):
            return False
        return self._part(self.edge(a, True), self.edge(b, False)) == (rank, True)


def encode_words(words, merges: Merges) -> dict[str, list[str]]:
    """Tokens of each distinct word (in byte letters, without the end mark).

    Words in order are the paths of a trie, depth first: the prefix that a word shares with
    the one before it is the path that stays, and so do its states.  ``states`` has the last
    token of each prefix on the path, ``heads`` its longest end that begins a token.  The last
    letter of a word carries the end mark, so a word's own last token is looked for among
    marked tokens after the state of a shorter prefix.
    """
    out: dict[str, list[str]] = {}
    path, states, heads = "", [""], [""]
    after, ends, marked_ends = merges.after, merges.ends, merges.marked_ends
    for word in words:
        shared, most = 0, min(len(path), len(word), len(states) - 1)
        while shared < most and path[shared] == word[shared]:
            shared += 1
        del states[shared + 1 :], heads[shared + 1 :]
        head = heads[shared]
        for depth in range(shared + 1, len(word)):
            text = head + word[depth - 1]
            head = after.get(text) or merges.step(text)
            found = ends.get(head) or merges.tokens_at(head, "")
            heads.append(head)
            states.append(last_token(found, depth, states, merges))
        text = heads[len(word) - 1] + word[-1]
        head = after.get(text) or merges.step(text)
        found = marked_ends.get(head) or merges.tokens_at(head, END)
        out[word] = _spell(last_token(found, len(word) + len(END), states, merges), word, states)
        path = word
    return out


def last_token(found: tuple[str, ...], depth: int, states: list[str], merges: Merges) -> str:
    """The last token of the prefix of ``depth`` letters, out of those that it ends in."""
    met = merges.met
    for t in found:
        before = states[depth - len(t)]
        if not before:
            return t
        apart = met.get((before, t))
        if apart or (apart is None and merges.beside(before, t)):
            return t
    raise ValueError(f"no token ends the prefix of {depth} letters")


def _spell(last: str, word: str, states: list[str]) -> list[str]:
    """All tokens, from the last one back through the states of the path."""
    tokens, at = [last], len(word) - len(last) + len(END)
    while at:
        tokens.append(states[at])
        at -= len(states[at])
    return tokens[::-1]


class WordCoder:
    """Encodes whole texts: cuts them at white space and keeps what it has encoded.

    A text's ids are those of its blank-free stretches in a row, since neither the
    normalizer nor the split pattern looks across white space.
    """

    def __init__(self, vocabulary: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        self.merges = Merges(spec)
        self.library = Tokenizer.from_str(vocabulary)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(pattern)
        self.letters = byte_letters()
        self.latin = re.compile("[\x00-\u024f]*").fullmatch
        self.odd_space = re.compile("[\x1c-\x1f]").search
        self.stretch = re.compile(f"[^{SPACE}]+")
        self.marks = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")")
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.words: dict[str, tuple[bytes, bytes]] = {}

    def _words(self, stretch: str) -> list[str]:
        """Words in byte letters, after normalizing."""
        if stretch.isascii() and stretch.isalpha():
            return [stretch.lower()]
        if self.latin(stretch):
            # In this range no letters compose, and both lower-case alike.
            low = stretch.lower()
            if low.isalpha():
                return [low if low.isascii() else self._spelt(low)]
            stem = low.rstrip(STOPS)
            if stem.isalpha():
                return [stem if stem.isascii() else self._spelt(stem), low[len(stem) :]]
            found = self.cut.findall(low)
            return [w if w.isascii() and w.isprintable() else self._spelt(w) for w in found]
        plain = self.library.normalizer.normalize_str(stretch)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def _spelt(self, word: str) -> str:
        return "".join([self.letters[b] for b in word.encode("utf-8")])

    def _learn(self, stretches) -> None:
        cut = {s: self._words(s) for s in stretches}
        code, known = self.merges.codes.__getitem__, self.words
        # In order, so that words with a common prefix are neighbours.
        new = sorted(set().union(*cut.values()) - known.keys())
        for i in range(0, len(new), TRIE_WORDS):
            for w, tokens in encode_words(new[i : i + TRIE_WORDS], self.merges).items():
                # with the blank that follows it, unless it ends the text
                known[w] = (b"".join(map(code, tokens)), (" ".join(tokens) + " ").encode())
        for s, words in cut.items():
            if len(words) == 1:
                self.memo[s] = known[words[0]]
            else:
                got = [known[w] for w in words]
                self.memo[s] = (b"".join([g[0] for g in got]), b"".join([g[1] for g in got]))

    def _parts(self, text: str) -> list[str]:
        split = self.stretch.findall if self.odd_space(text) else str.split
        if "<|" not in text:
            return split(text)
        return [
            s
            for i, part in enumerate(self.marks.split(text))
            for s in ([part] if i % 2 else split(part))
        ]

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        return [(ids, text.decode()) for ids, text in self.encoded(texts)]

    def encoded(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """The same with the decoded text in UTF-8."""
        with no_cycles():
            keys, places, edges = distinct([self._parts(t or "") for t in texts])
            if len(self.memo) + len(keys) > MEMO:
                self.memo.clear()
                self.words.clear()
            self.memo.update(
                {t: (i.to_bytes(4, "little"), f"{t} ".encode()) for t, i in self.merges.special.items()}
            )
            self._learn([k for k in keys if k not in self.memo])
            got = list(map(self.memo.__getitem__, keys))
            ids = joined([g[0] for g in got], places, edges)
            decoded = joined([g[1] for g in got], places, edges)
            return [(i, t[:-1]) for i, t in zip(ids, decoded, strict=True)]


def encode_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row, from whole texts.

    ``vocabulary`` is the text of a tokenizer file with word-end marks; it has a fixed
    size and goes to the tasks along with the code.  Distinct stretches of a batch are
    encoded together in one trie; a task keeps at most ``MEMO`` of them.  A null or empty
    text has no tokens, and its digests are those of nothing.  Repeated rows get a row
    each; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        coder = WordCoder(shared.value)

        def work(texts):
            return [
                (
                    len(ids) // 4,
                    hashlib.sha256(ids).hexdigest(),
                    hashlib.sha256(text).hexdigest(),
                )
                for ids, text in coder.encoded(texts)
            ]

        return work

    return per_document(
        narrow(docs, id_col, text_col),
        make,
        "n_tokens long,ids_sha256 string,decoded_sha256 string",
    )
