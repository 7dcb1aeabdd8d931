"""Token counts of a unigram tokenizer without making the tokens."""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.words import small_batches

BLANK = "▁"
#: A task's table of words takes words up to so many characters, and is emptied at so many words.
LONGEST_WORD, WORDS_HELD = 64, 250_000
UNKNOWN_PENALTY = 10.0


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with a column ``out``: the tokens of each whole text under a unigram vocabulary.

    The text gets a blank before it and blanks become a visible mark, as pieces know
    them. Aho-Corasick finds all pieces in a word; per end of a piece the dynamic
    program keeps the best score and the number of pieces on the way there. Ties go to the
    longer piece. A character without a piece of its own costs the least score of the
    vocabulary less ten and counts its bytes in UTF-8. No piece has a blank after another
    character, so words are counted one by one, and common words once per task.

    A null or empty text has no tokens. Rows repeat as they are, all other columns
    stay, and a column already named ``out`` is replaced.
    """
    small_batches(docs.sparkSession)
    counted = F.pandas_udf(_counter(vocabulary), "long")(F.coalesce(F.col(text), F.lit("")))
    return docs.withColumn(out, counted)


def vocabulary_scores(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model file, without control and unknown symbols."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}


def viterbi_counter(scores: dict[str, float]) -> Callable[[str], int]:
    """Makes the function from a word to the number of pieces on its best path."""
    import ahocorasick

    known = ahocorasick.Automaton()
    for piece, score in scores.items():
        known.add_word(piece, (len(piece), score))
    known.make_automaton()
    unknown = min(scores.values()) - UNKNOWN_PENALTY

    def count(word: str) -> int:
        size = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, match in known.iter(word):
            ends[end].append(match)
        best, pieces = [0.0] * (size + 1), [0] * (size + 1)
        for end, matches in enumerate(ends):
            top, number, single = None, 0, False
            for length, score in sorted(matches, reverse=True):  # the longest first: it keeps ties
                start = end + 1 - length
                path = best[start] + score
                if top is None or path > top:
                    top, number = path, pieces[start] + 1
                single = single or length == 1
            if not single:
                path = best[end] + unknown
                if top is None or path > top:
                    top, number = path, pieces[end] + len(word[end].encode("utf-8", "surrogatepass"))
            best[end + 1], pieces[end + 1] = top, number
        return pieces[size]

    return count


def _counter(path: str) -> Callable:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re

        scores = vocabulary_scores(path)
        if any(BLANK in p.lstrip(BLANK) for p in scores):
            raise ValueError("a piece holds a blank after another character")
        count = viterbi_counter(scores)
        runs = re.compile(" +[^ ]*").findall

        class Words(dict):
            def __missing__(self, word: str) -> int:
                found = count(word.replace(" ", BLANK))
                if len(word) <= LONGEST_WORD:
                    if len(self) >= WORDS_HELD:
                        self.clear()
                    self[word] = found
                return found

        words = Words()

        def tokens(text: str) -> int:
            if not text:
                return 0
            text = text.replace(BLANK, " ")
            if text[0] == " " or text[-1] == " " or "  " in text:
                return sum(map(words.__getitem__, runs(" " + text)))
            return sum(map(words.__getitem__, [" " + w for w in text.split(" ")]))

        for texts in batches:
            yield texts.map(tokens).astype("int64")

    return run
