"""Token counts under a unigram vocabulary, without building the tokens.

Viterbi over vocabulary matches: an Aho-Corasick automaton lists every piece that
ends at each position; the recursion carries only the best score and the number of
pieces of the best path. Tie rules are the tokenizer's own: paths are extended in
order of the start of their last piece and replaced by a strictly better score
only, so among equal scores the piece that starts first (the longest) stays; the
unknown piece of one character comes last. An unknown character counts as its
UTF-8 bytes if the vocabulary has byte pieces, else a run of them counts as one.

Text is prepared as usual for such vocabularies: U+2581 for each space and one in
front. Where no piece holds U+2581 behind another character, no path crosses the
start of a word, so a text's count is the sum over its words; each worker then
remembers counts of the words that it has seen, and the recursion runs once for
each. That is done only if all scores are whole numbers, whose sums are exact: else
sums over whole texts may round otherwise than sums over words and ties differ, and
the recursion runs over whole texts.

No shuffle, no state between tasks: a lost executor's tasks simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import blocks, bounded_batches

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Penalty of an unknown character below the least score.
UNKNOWN_PENALTY = 10.0
#: Words remembered in each worker; beyond it the memory starts anew.
REMEMBERED = 500_000


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores and the id of the unknown piece. Byte and control pieces
    are part of the list, as they are for the tokenizer."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], unknown_id: int | None = 0):
        scores = dict(reversed(pieces))  # the first of equal pieces counts
        self.least = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytewise = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.machine = ahocorasick.Automaton()
        for piece, score in scores.items():
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        whole = all(float(score).is_integer() for score in scores.values())
        self.by_word = whole and not any(MARK in piece.lstrip(MARK) for piece in scores)
        self.known: dict[str, int] = {}

    def best(self, text: str) -> int:
        """Pieces of the best path through text; text holds no raw spaces."""
        n = len(text)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        reached = -1  # the last end that iter() has passed

        def close(end: int, matches: list[tuple[int, float]]) -> None:
            """Settle position end. matches: (length, score), longest first."""
            top, pieces, single = -float("inf"), 0, False
            for length, own in matches:
                single |= length == 1
                if (value := score[end - length] + own) > top:
                    top, pieces = value, count[end - length] + 1
            gap = False
            if not single and (value := score[end - 1] + self.least) > top:
                size = len(text[end - 1].encode("utf-8", "surrogatepass"))
                fused = unknown[end - 1] and not self.bytewise
                top, pieces, gap = value, count[end - 1] + (size if self.bytewise else 0 if fused else 1), True
            score[end], count[end], unknown[end] = top, pieces, gap

        matches: list[tuple[int, float]] = []
        for last, (length, own) in self.machine.iter(text) if len(self.machine) else ():
            if last != reached:
                if matches:
                    close(reached + 1, matches)
                for end in range(reached + 2, last + 1):
                    close(end, [])
                reached, matches = last, []
            matches.append((length, own))
        if matches:
            close(reached + 1, matches)
        for end in range(reached + 2, n + 1):
            close(end, [])
        return count[n]

    def word(self, word: str) -> int:
        pieces = self.known.get(word)
        if pieces is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            pieces = self.known[word] = self.best(MARK + word)
        return pieces

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.best(text)
        if MARK + MARK not in text and text[-1] != MARK:  # plain words: most texts
            found = list(map(self.known.get, words := text.split(MARK)[1:]))
            return sum(found) if None not in found else sum(self.word(w) if c is None else c for w, c in zip(words, found, strict=True))
        total, run = 0, 0
        for word in text.split(MARK)[1:]:
            if not word:  # further marks belong to the word behind them
                run += 1
                continue
            word = MARK * run + word if run else word
            run = 0
            total += self.word(word)
        return total + (self.best(MARK * run) if run else 0)


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_chars (code points), n_tokens (pieces of the best path).

    Null and empty texts have 0 tokens; repeated rows and null ids each keep a row;
    other columns are not read. vocabulary is a model file's path, which is read
    once on the driver; its pieces (a fixed vocabulary) go to the tasks.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    pieces, unknown = read_vocabulary(vocabulary)
    shared = spark.sparkContext.broadcast({"pieces": pieces, "unknown": unknown})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value  # one for each worker, so what it remembers outlives a task
        counter = held.setdefault("counter", None) or UnigramCounter(held["pieces"], held["unknown"])
        held["counter"] = counter
        for batch in blocks(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array([counter.count(t) for t in texts], pa.int64())], names=["id", "n_chars", "n_tokens"])

    source = documents.selectExpr(f"cast(`{id_column}` as long) as id", f"`{text_column}` as text")
    return source.mapInArrow(run, "id long, n_chars long, n_tokens long").toDF(id_column, "n_chars", "n_tokens")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the 32k piece vocabulary."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
