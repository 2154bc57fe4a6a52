"""Token counts of a unigram tokenizer, without making the tokens."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.llm.common import text_array, text_slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
"""Fixed value: an unknown character scores this much less than the lowest piece."""
_MARK = "▁"
_CACHED_WORDS = 400_000
_CACHED_LENGTH = 48


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file, in the order of their ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class TokenCounter:
    """Counts pieces of the best segmentation; see :func:`token_counts` for the rules."""

    def __init__(self, pieces: Sequence[tuple[str, float]], byte_fallback: bool = True) -> None:
        self._matches = ahocorasick.Automaton()
        self._single = set()
        for piece, score in pieces:
            if piece:
                self._matches.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self._single.add(piece)
        self._matches.make_automaton()
        self._unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self._bytes = byte_fallback
        self._known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of one word, by dynamic programming over the ends of its matches.

        A segmentation is replaced only by a strictly better one, and matches of one end
        come longest first, so ties go to the earliest start, that is the longest last
        piece. A character that is no piece by itself may be crossed as unknown.
        """
        size = len(word)
        best: list[float | None] = [0.0] + [None] * size
        count = [0] * (size + 1)
        fused = [False] * (size + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for last, match in self._matches.iter(word):
            ends[last + 1].append(match)
        for end in range(1, size + 1):
            top, pieces = None, 0
            for length, score in ends[end]:
                total = best[end - length] + score
                if top is None or total > top:
                    top, pieces = total, count[end - length] + 1
            character = word[end - 1]
            if character not in self._single:
                total = best[end - 1] + self._unknown
                if top is None or total > top:
                    top, fused[end] = total, True
                    if self._bytes:
                        pieces = count[end - 1] + len(character.encode("utf-8", "replace"))
                    else:
                        pieces = count[end - 1] + (not fused[end - 1])
            best[end], count[end] = top, pieces
        return count[size]

    def text(self, text: str) -> int:
        """Pieces of a text: each space starts a word, and so does the beginning."""
        if not text:
            return 0
        marked = text.replace(" ", _MARK)
        if marked[0] == _MARK:
            marked = marked[1:]
        total, known = 0, self._known
        for word in marked.split(_MARK):
            found = known.get(word)
            if found is None:
                found = self.word(_MARK + word)
                if len(word) <= _CACHED_LENGTH:
                    if len(known) >= _CACHED_WORDS:
                        known.clear()
                    known[word] = found
            total += found
        return total


def token_counts(
    documents: DataFrame,
    vocabulary: str = VOCABULARY,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Rows ``doc_id``, ``n_tokens`` for the pieces and scores of a vocabulary file.

    The count is that of a unigram tokenizer with byte fallback: spaces become the word
    mark, a word starts at each mark, and a word's pieces are those of highest total
    score. Only the best score and its number of pieces are carried, never the pieces.
    The file is read on the driver and sent to the tasks; it does not grow with the data.

    The registered vocabulary is a BPE model, whose scores are merge ranks: the counts are
    those of a unigram model over them, not those of the file's own tokenizer.

    Null and empty texts have no tokens. Null ids stay null, repeated rows each give a
    row, and an empty table gives an empty result.
    """
    pieces = load_pieces(vocabulary)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(pieces)
        for batch in text_slices(batches, "__text"):
            found = [counter.text(value.as_py()) for value in text_array(batch, "__text")]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "n_tokens": pa.array(found, pa.int64())}
            )

    rows = documents.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("__text")
    )
    return rows.mapInArrow(counted, "doc_id bigint, n_tokens bigint")
