"""Token counts of a unigram vocabulary without tokenizing: Aho-Corasick matches and a count-only Viterbi."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache as once

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_BYTE = re.compile(r"<0x[0-9A-F]{2}>")
CACHE = 400_000


@once
def default_vocabulary() -> tuple[tuple[str, float], ...]:
    """The pieces of the public 32k model, without control pieces, with log-probabilities by Zipf's law over their rank.

    That model merges pairs; its own scores are minus the ranks of merges, no logarithms of anything, and summing them
    would split common words. A piece that was merged early is frequent, so the n-th piece gets a share in proportion to
    1 / n; single characters, which were not merged, stand at the end. The counts are exactly those of the unigram
    tokenizer with this vocabulary. No such tokenizer is published: they come near the model's own counts, without
    being equal to them. Pass the pieces and scores of a published unigram model to have its counts.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [(model.get_score(i), i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]
    rank = {i: n for n, (_, i) in enumerate(sorted((p for p in pieces if not model.is_byte(p[1])), key=lambda p: (-p[0], p[1])), 1)}
    last = len(rank) + 1  # bytes stand for what is rarer than any piece
    whole = sum(1 / n for n in rank.values())
    return tuple((model.id_to_piece(i), -math.log(whole * rank.get(i, last))) for _, i in pieces)


class CountViterbi:
    """Best segmentation's number of pieces for one pre-token.

    As the tokenizers library decides: of two ways to a position the one of strictly greater score wins, starts being
    tried from the left, so a tie goes to the longest last piece. A character that no piece starts with alone is
    unknown, at the lowest score less 10; neighbouring unknown characters are one token, or where the vocabulary has
    byte pieces as many as they have bytes.
    """

    def __init__(self, vocabulary: tuple[tuple[str, float], ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        pieces = dict(reversed(vocabulary))  # of repeated pieces the first counts
        self.bytes = sum(1 for p in pieces if _BYTE.fullmatch(p)) == 256
        for p, score in pieces.items():
            if p:
                self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p in pieces if len(p) == 1}

    def known(self, word: str, n: int) -> int:
        """Tokens of a word whose characters are all pieces: every position is reached. The automaton gives the longest match first."""
        best, count = [float("-inf")] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for at, (length, score) in self.automaton.iter(word):
            at += 1
            start = at - length
            s = best[start] + score
            if s > best[at]:
                best[at] = s
                count[at] = count[start] + 1
        return count[n]

    def __call__(self, word: str) -> tuple[int, int]:
        """(tokens, unknown characters)"""
        n = len(word)
        if self.single.issuperset(word):
            return self.known(word, n), 0
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        # tokens so far, unknown characters so far, whether the last one is unknown
        count, unknown, last = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0
        matches: list = []

        def settle(end: int) -> None:
            # longest first is leftmost start first
            for length, score in sorted(matches, reverse=True):
                start = end - length
                s = best[start] + score
                if s > best[end]:
                    best[end], count[end], unknown[end], last[end] = s, count[start] + 1, unknown[start], False
            matches.clear()
            c = word[end - 1]
            if c not in self.single:
                s = best[end - 1] + self.unknown
                if s > best[end]:
                    more = len(c.encode("utf-8", "surrogatepass")) if self.bytes else int(not last[end - 1])
                    best[end], count[end], unknown[end], last[end] = s, count[end - 1] + more, unknown[end - 1] + 1, True

        for at, found in self.automaton.iter(word):
            while done < at:
                done += 1
                settle(done)
            matches.append(found)
        while done < n:
            done += 1
            settle(done)
        return count[n], unknown[n]


def _counts(vocabulary: tuple[tuple[str, float], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = CountViterbi(vocabulary)
        cache: dict[str, tuple[int, int]] = {}
        for batch in batches:
            tokens, unknown = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                a = b = 0
                if text:
                    marked = text.replace(" ", MARK)
                    words = marked.split(MARK)
                    if not words[0]:
                        words = words[1:]
                    for w in words:
                        found = cache.get(w)
                        if found is None:
                            found = viterbi(MARK + w)
                            if len(w) <= 64:
                                if len(cache) >= CACHE:
                                    cache.clear()
                                cache[w] = found
                        a += found[0]
                        b += found[1]
                tokens.append(a), unknown.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(unknown, pa.int64())], ["id", "n_tokens", "n_unknown"])

    return run


def unigram_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[tuple[str, float], ...] | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_unknown) for every row, over whole texts.

    Words stand between spaces and carry a mark in front, as the library's Metaspace step makes them; each is decided by
    itself, from a score of 0, so equal words have equal counts and are decided once. Of segmentations of one score the
    one with the longest last piece counts, as in the library. Null and empty texts: 0. Texts of any length are counted
    whole, a word at a time; repeated rows, and rows without an id, are counted each; extra columns of any name are left
    out; an empty table gives none.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = rows.mapInArrow(_counts(vocabulary or default_vocabulary()), f"id {kind}, n_tokens bigint, n_unknown bigint")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_unknown")
