"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can be the last of its encoding
(the encoding of a prefix does not change what a longer text may still become,
it only has one last token). A suffix automaton of the vocabulary, walked once
along the word, names the tokens that end at each place; a token is the last
one of a prefix if it is the whole prefix, or if it is compatible with the last
token of the prefix before it, that is, if the two encode to just themselves.
Following the back-pointers from the end gives the ids.

The vocabulary is that of a ``tokenizers`` file with word ends (``</w>``):
NFC, lower case, words split off by the file's pattern, bytes as characters.
Words repeat, so texts are taken in groups, whose new words are encoded once, in
alphabetical order so that shared prefixes are too, and each worker keeps the
encodings of recent white-space chunks in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import held

END = "</w>"
CACHE = 80_000
#: Tokens of one output batch and characters of texts taken together, about; a word's length whose tables are kept.
SENT, TAKEN, LONGEST = 1 << 19, 1 << 20, 1 << 10
#: Characters of the longest chunk that is remembered.
KEPT = 64
#: The white space and the word pattern of the tokenizer file.
SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Compiled:
    """Tables of a vocabulary, small enough to broadcast (a few MB).

    Tokens are numbered by age: base symbols first, then one per merge. A
    symbol is a character, or a character that ends its word.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        vocab, merges = found["model"]["vocab"], found["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.special = {x["content"]: x["id"] for x in found["added_tokens"]}
        made = {a + b for a, b in merges}
        base = [t for t in vocab if t not in made]
        names = [*base, *(a + b for a, b in merges)]
        age = {t: i for i, t in enumerate(names)}
        if len(age) != len(names):
            raise ValueError("two merges make the same token")
        self.names, self.base = names, len(base)
        self.ids = array("i", (vocab[t] for t in names))
        self.halves = array("i", (age[x] for m in merges for x in m))
        self.symbols = {t: i for i, t in enumerate(base)}
        self._automaton([self._spelled(t) for t in names])

    def _spelled(self, token: str) -> list[int]:
        if token.endswith(END) and len(token) > len(END):
            body = token[: -len(END)]
            return [self.symbols[c] for c in body[:-1]] + [self.symbols[body[-1] + END]]
        return [self.symbols[c] for c in token]

    def _automaton(self, words: list[list[int]]) -> None:
        """The suffix automaton of all tokens: moves, suffix links, lengths, and the tokens that end at each state."""
        step: list[dict[int, int]] = [{}]
        link, size = [-1], [0]

        def state(moves, to, length):
            step.append(moves)
            link.append(to)
            size.append(length)
            return len(step) - 1

        def split(p, c, q):
            twin = state(dict(step[q]), link[q], size[p] + 1)
            link[q] = twin
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = twin
                p = link[p]
            return twin

        own = {}
        for number, word in enumerate(words):
            last = 0
            for c in word:
                q = step[last].get(c)
                if q is not None:
                    last = q if size[q] == size[last] + 1 else split(last, c, q)
                    continue
                new, p = state({}, 0, size[last] + 1), last
                while p >= 0 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = step[p][c]
                    link[new] = q if size[q] == size[p] + 1 else split(p, c, q)
                last = new
            own[number] = last
        token = array("i", [-1]) * len(step)
        for number, word in enumerate(words):  # a clone may have taken a state's place
            at = 0
            for c in word:
                at = step[at][c]
            token[at] = number
        up = array("i", [-1]) * len(step)
        for v in sorted(range(1, len(step)), key=size.__getitem__):
            up[v] = link[v] if token[link[v]] >= 0 else up[link[v]]
        self.moves, self.link, self.size, self.token, self.up = step, link, size, token, up


class Encoder:
    """Encodes and decodes with a ``Compiled`` vocabulary; one per Python worker."""

    def __init__(self, tables: Compiled):
        self.t = tables
        chars = byte_chars()
        self.inner = [tables.symbols[c] for c in chars]
        self.final = [tables.symbols[c + END] for c in chars]
        self.words = regex.compile(WORDS)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(tables.special, key=len, reverse=True))) + ")") if tables.special else None
        self.wide = len(tables.names) + 1  # a pair of tokens is one number
        self.parents = {a * self.wide + b: tables.base + i for i, (a, b) in enumerate(zip(tables.halves[::2], tables.halves[1::2], strict=True))}
        self.sides: dict[int, list[int]] = {}
        self.fit: dict[int, bool] = {}
        self.ends: list[list[tuple[int, int]] | None] = [None] * len(tables.size)
        self.ends[0] = []
        self.name = {str(i): t for i, t in zip(tables.ids, tables.names, strict=True)} | {str(i): t for t, i in tables.special.items()}
        self.known: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self._forget()

    def _spine(self, token: int, side: int) -> list[int]:
        """What stood at one edge of ``token`` while it grew, oldest first."""
        key = token * 2 + side
        if (found := self.sides.get(key)) is None:
            found, x = [token], token
            while x >= self.t.base:
                x = self.t.halves[2 * (x - self.t.base) + side]
                found.append(x)
            found.reverse()
            self.sides[key] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` side by side encode to just themselves.

        Both grow by their own merges, in order of age. They stay apart unless
        a merge across the border comes due before the next one on either side;
        of equal merges the one further left goes first.
        """
        pair = left * self.wide + right
        if (known := self.fit.get(pair)) is not None:
            return known
        a, b, i, j, never, ok = self._spine(left, 1), self._spine(right, 0), 0, 0, len(self.t.names), True
        while True:
            due_a = a[i + 1] if i + 1 < len(a) else never
            due_b = b[j + 1] if j + 1 < len(b) else never
            across = self.parents.get(a[i] * self.wide + b[j], never)
            if across < due_a and across <= due_b and across < never:
                ok = False
                break
            if due_a == never and due_b == never:
                break
            i, j = i + (due_a <= due_b), j + (due_b <= due_a)
        if len(self.fit) > 200_000:
            self.fit.clear()
        self.fit[pair] = ok
        return ok

    def _ends(self, state: int) -> list[tuple[int, int]]:
        """(length, token) of the tokens that end where a state is wholly matched, longest first."""
        if state < 0:
            return []
        if (known := self.ends[state]) is None:
            t = self.t
            known = ([(t.size[state], t.token[state])] if t.token[state] >= 0 else []) + self._ends(t.up[state])
            self.ends[state] = known
        return known

    def word(self, text: str) -> list[int]:
        """The tokens (by age) of one pre-token.

        What was found for a prefix that the word before shares is taken over,
        so words in alphabetical order cost little more than what is new in them.
        """
        raw = text.encode("utf-8", "surrogatepass")
        inner, moves, link, size, ends, fit, wide = self.inner, self.t.moves, self.t.link, self.t.size, self.ends, self.fit.get, self.wide
        spelled = [inner[x] for x in raw]
        spelled[-1] = self.final[raw[-1]]
        last, back, states, lengths = self.last, self.back, self.states, self.lengths
        end = 0
        for x, y in zip(self.before, spelled):  # noqa: B905
            if x != y:
                break
            end += 1
        self.before = spelled
        del last[end + 1 :], back[end + 1 :], states[end + 1 :], lengths[end + 1 :]
        state, length = states[end], lengths[end]
        for c in spelled[end:]:
            end += 1
            while c not in moves[state]:
                state = link[state]
                length = size[state]
            state = moves[state][c]
            length += 1
            at = state if length == size[state] else link[state]
            for n, x in ends[at] or self._ends(at):
                if n == end:
                    break
                left = last[end - n]
                ok = fit(left * wide + x)
                if ok or (ok is None and self.compatible(left, x)):
                    break
            last.append(x)
            back.append(end - n)
            states.append(state)
            lengths.append(length)
        out, at = [], end
        while at:
            out.append(last[at])
            at = back[at]
        if end > LONGEST:  # a long word's tables are not kept
            self._forget()
        return out[::-1]

    def _forget(self) -> None:
        self.before, self.last, self.back, self.states, self.lengths = [], [-1], [-1], [0], [0]

    def _pieces(self, text: str | None) -> list[list[str] | str]:
        """A text as special tokens (strings) and the lists of chunks between them."""
        out: list[list[str] | str] = []
        for part in self.special.split(text) if text and any(x in text for x in self.t.special) else [text or ""]:
            if part in self.t.special:
                out.append(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            odd = any(c in part for c in "\x1c\x1d\x1e\x1f")  # white space to str.split alone
            out.append([x for x in regex.split(f"[{SPACE}]+", part) if x] if odd else part.split())
        return out

    def encode_all(self, texts: list[str | None]) -> list[str]:
        """The ids of whole texts, each joined by a space.

        Chunks that are not known yet are looked up first, their words in
        alphabetical order. Known ones are kept in two generations: a full
        table becomes the old one, and what is asked for again moves back, so
        common chunks stay and memory is bounded. Long chunks are not kept.
        """
        known, old, special = self.known, self.old, self.t.special
        cut = [self._pieces(text) for text in texts]
        asked = set().union(*(part for pieces in cut for part in pieces if part.__class__ is list))
        new = []
        for x in asked.difference(known):
            if (found := old.get(x)) is None:
                new.append(x)
            else:
                known[x] = found
        split = [self.words.findall(x) for x in new]
        made = {w: known.get(w) or old.get(w) for words in split for w in words}
        ids = self.t.ids
        for w in sorted(w for w, found in made.items() if found is None):
            made[w] = " ".join([str(ids[x]) for x in self.word(w)])
        for x, words in zip(new, split, strict=True):
            known[x] = made[x] if len(words) == 1 else " ".join([made[w] for w in words])
        for w, found in made.items():
            known[w] = found
        out = [" ".join([y for part in pieces for y in ([known[x] for x in part] if part.__class__ is list else [str(special[part])])]) for pieces in cut]
        for x in new:
            if len(x) > KEPT:
                known.pop(x, None)
        for w in made:
            if len(w) > KEPT:
                known.pop(w, None)
        if len(known) > CACHE:
            self.known, self.old = {}, known
        return out

    def encode(self, text: str | None) -> str:
        """The ids of one whole text, joined by a space."""
        return self.encode_all([text])[0]

    def decode(self, ids: str) -> str:
        """The token strings joined by a space, for the file names no decoder."""
        return " ".join([self.name[x] for x in ids.split()])


def _encoded(enc: Encoder, texts):
    """The ids of an Arrow column's texts, some taken together."""
    taken, size = [], 0
    for text in texts:
        taken.append(text.as_py())
        size += len(taken[-1] or "")
        if size >= TAKEN:
            yield from enc.encode_all(taken)
            taken, size = [], 0
    yield from enc.encode_all(taken)


def encoder(tables) -> Encoder:
    """The worker's encoder for a broadcast vocabulary."""
    return held(("bpe", tables.value.mark), lambda: Encoder(tables.value))


def compiled(spark: SparkSession, path: str):
    """Broadcast tables of the vocabulary at ``path`` (their size is the vocabulary's)."""
    tables = Compiled(path)
    tables.mark = hashlib.sha256(repr((path, len(tables.names), tables.names[-1])).encode()).hexdigest()
    return spark.sparkContext.broadcast(tables)


def encode_documents(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """doc_id, n_tokens and ``outputs`` of every row of ``docs`` (doc_id, text).

    ``outputs`` may name ``ids`` (array<int>), ``decoded``, ``ids_sha256`` and
    ``decoded_sha256``. Null and empty texts have no tokens. Special tokens
    written in a text are special. Rows are independent: repeated rows and null
    doc_ids come back as they are; other columns of ``docs`` are ignored.
    """
    kinds = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    types = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    make = {
        "ids": lambda i, d: np.fromstring(i, np.int32, sep=" "),
        "decoded": lambda i, d: d,
        "ids_sha256": lambda i, d: hashlib.sha256(i.encode()).hexdigest(),
        "decoded_sha256": lambda i, d: hashlib.sha256(d.encode()).hexdigest(),
    }
    told = any(x.startswith("decoded") for x in outputs)
    tables = compiled(docs.sparkSession, path)

    def run(batches):
        enc = encoder(tables)
        for batch in batches:
            begin, n, tokens, cols = 0, [], 0, {x: [] for x in outputs}
            for at, ids in enumerate(_encoded(enc, batch.column("text")), 1):
                decoded = enc.decode(ids) if told else None
                n.append(ids.count(" ") + 1 if ids else 0)
                tokens += n[-1]
                for x in outputs:
                    cols[x].append(make[x](ids, decoded))
                if tokens >= SENT or at == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id")[begin:at], pa.array(n, pa.int64()), *(pa.array(cols[x], types[x]) for x in outputs)], names=["doc_id", "n_tokens", *outputs])
                    begin, n, tokens, cols = at, [], 0, {x: [] for x in outputs}

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long" + "".join(f", {x} {kinds[x]}" for x in outputs))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ("ids_sha256", "decoded_sha256"))
