"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton names the pieces that end at each character; the
dynamic program keeps the best score of each prefix and the number of pieces
that reach it. Ties follow the ``tokenizers`` library's unigram model exactly:
of equal scores the piece that starts first stays; where no piece is just the
next character, the unknown piece takes it for the lowest score less 10; and
neighbouring unknown pieces are one token.

Words are what white space separates, each with the leading mark of the
vocabulary. Words repeat, so each worker keeps recent counts in a table of
fixed size.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Recent, held

MARK = "▁"
UNKNOWN_COST = 10.0
CACHE = 150_000
ODD_SPACE = re.compile(r"[^\S\x1c-\x1f]+")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece file, the unknown piece first."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i))]
    return [(sp.id_to_piece(sp.unk_id()), 0.0), *((sp.id_to_piece(i), float(sp.get_score(i))) for i in plain)]


class Counter:
    """Counts the pieces of texts; one per Python worker."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.auto = ahocorasick.Automaton()
        for piece, score in pieces:
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.ring = max(len(piece) for piece, _ in pieces) + 1
        self.unknown = min(score for _, score in pieces) - UNKNOWN_COST
        self.words = Recent(self.marked, CACHE)

    def marked(self, word: str) -> tuple[int, float]:
        """A word with its leading mark; one that holds the mark itself is cut before each."""
        parts = [MARK + x for x in word.removeprefix(MARK).split(MARK)]
        got = [self.word(x) for x in parts]
        return sum([n for n, _ in got]), sum([x for _, x in got])

    def word(self, word: str) -> tuple[int, float]:
        """Number of pieces and score of the best split of one marked word.

        Only as many places as the longest piece has characters are held.
        """
        ring, matches, unknown = self.ring, self.auto.iter(word), self.unknown
        best, count, odd = [0.0] * ring, [0] * ring, [False] * ring
        coming = next(matches, None)
        for end in range(1, len(word) + 1):
            here = []
            while coming is not None and coming[0] + 1 == end:
                here.append(coming[1])
                coming = next(matches, None)
            here.sort(reverse=True)
            top, n, is_odd, single = None, 0, False, False
            for size, score in here:
                single |= size == 1
                got = best[(end - size) % ring] + score
                if top is None or got > top:
                    top, n, is_odd = got, count[(end - size) % ring] + 1, False
            if not single:
                before = (end - 1) % ring
                got = best[before] + unknown
                if top is None or got > top:
                    top, n, is_odd = got, count[before] + (not odd[before]), True
            at = end % ring
            best[at], count[at], odd[at] = top, n, is_odd
        return count[len(word) % ring], best[len(word) % ring]

    def text(self, text: str | None) -> tuple[int, float]:
        """Number of pieces and total score of a text."""
        known, text = self.words, text or ""
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # white space to str.split alone
        got = [known[w] for w in (filter(None, ODD_SPACE.split(text)) if odd else text.split())]
        return sum([n for n, _ in got]), sum([x for _, x in got], 0.0)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, score (sum of the chosen pieces' scores) of every row.

    Null, empty and blank texts have no tokens and score 0. Rows are
    independent: repeated rows and null doc_ids come back as they are; other
    columns of ``docs`` are ignored. The vocabulary is broadcast; its size is
    that of the file at ``path``.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        counter = held(("unigram", path), lambda: Counter(pieces.value))
        for batch in batches:
            got = [counter.text(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "n_tokens", "score"])

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
