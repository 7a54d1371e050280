"""Token counts by trie-shared dynamic programming.

Distinct pre-tokens are put into a trie. Each node holds the forward score of its prefix under a unigram model, the best
sum of piece scores over all ways to cut the prefix up, and how many pieces that way has. A node is computed once for all
pre-tokens that share the prefix; a pre-token's count is read at its last node.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_by_worker, named

MARK = "▁"  # stands for the space before a word
FALLBACK = 10.0  # a byte of a character without piece scores this much below the last piece


def unigram_scores(pieces: list[str]) -> dict[str, float]:
    """Log probabilities of ``pieces``, most frequent first, by Zipf's law: p(rank) ~ 1 / (rank + 2).

    The public vocabulary files have ranks but no unigram probabilities, and fitting these to a corpus would be training a
    tokenizer. So the law stands for them; give :class:`Trie` the scores of a unigram vocabulary where there is one.
    """
    total = math.log(sum(1 / (r + 2) for r in range(len(pieces))))
    return {p: -math.log(r + 2) - total for r, p in enumerate(pieces)}


def ranked_pieces(path: str) -> list[str]:
    """The pieces of a vocabulary file in order of rank, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    return [model.id_to_piece(i) for i in ids]


class Trie:
    """Forward scores of prefixes; emptied at ``room`` nodes or words, so memory is bounded whatever the corpus.

    A word of over ``LONG`` characters shares no prefix worth keeping: it is gone through with the last few scores alone.
    """

    LONG = 256

    def __init__(self, scores: dict[str, float], room: int = 600_000):
        self.scores, self.room = scores, room
        self.longest = max(map(len, scores), default=1)
        self.floor = min(scores.values(), default=0.0) - FALLBACK
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}
        self.score, self.pieces = array("d", [0.0]), array("q", [0])
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of the best segmentation of ``MARK + word``; of equal scores, the one with fewer pieces."""
        if len(word) > self.LONG:
            return self._count_long(MARK + word)
        if len(self.score) > self.room or len(self.known) > self.room // 2:
            self.clear()
        word_in = word
        word = MARK + word
        score, pieces, step, get = self.score, self.pieces, self.next, self.scores.get
        path, node = [0], 0
        for depth, c in enumerate(word, 1):
            edge = node * 0x110000 + ord(c)
            child = step.get(edge)
            if child is None:
                size = len(c.encode("utf-8", "surrogatepass"))
                best, least = score[node] + size * self.floor, pieces[node] + size
                for start in range(max(0, depth - self.longest), depth):
                    s = get(word[start:depth])
                    if s is not None:
                        before = path[start]
                        total = score[before] + s
                        if total > best or total == best and pieces[before] + 1 < least:
                            best, least = total, pieces[before] + 1
                child = step[edge] = len(score)
                score.append(best)
                pieces.append(least)
            node = child
            path.append(node)
        found = pieces[node]
        if len(word_in) < 64:
            self.known[word_in] = found
        return found

    def _count_long(self, word: str) -> int:
        """The same recurrence over a ring of as many prefixes as the longest piece reaches back."""
        ring, get = self.longest + 1, self.scores.get
        score, pieces = [0.0] * ring, [0] * ring
        for depth, c in enumerate(word, 1):
            size = len(c.encode("utf-8", "surrogatepass"))
            before = (depth - 1) % ring
            best, least = score[before] + size * self.floor, pieces[before] + size
            for start in range(max(0, depth - self.longest), depth):
                s = get(word[start:depth])
                if s is not None:
                    total = score[start % ring] + s
                    if total > best or total == best and pieces[start % ring] + 1 < least:
                        best, least = total, pieces[start % ring] + 1
            score[depth % ring], pieces[depth % ring] = best, least
        return pieces[len(word) % ring]

    def count_text(self, text: str | None) -> tuple[int, int]:
        """Pre-tokens (between white space) and pieces of a whole text."""
        words = (text or "").split()
        get, slow = self.known.get, self.count
        return len(words), sum([get(w) or slow(w) for w in words])


def count_column(text: Column, vocabulary: str) -> Column:
    """struct(n_pretokens, n_tokens) of a text. Each Python worker keeps a trie over its batches; nothing is shuffled."""

    @F.arrow_udf("struct<n_pretokens:long,n_tokens:long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = kept_by_worker(("trie", vocabulary), lambda: Trie(unigram_scores(ranked_pieces(vocabulary))))
        for texts in batches:
            found = [trie.count_text(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["n_pretokens", "n_tokens"])

    return of(text)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, n_pretokens, n_tokens``. Null and blank texts have none; null ids and repeated rows
    are counted like others; other columns are not read; an empty table gives no rows."""
    return docs.select(named(id_col).alias("id"), count_column(named(text_col), vocabulary).alias("c")).select("id", "c.n_pretokens", "c.n_tokens")
