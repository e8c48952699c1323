"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each
character; dynamic programming carries the best score and its number of pieces,
and never the pieces themselves. Ties go to the piece that starts earliest, as in
the exact tokenizer: pieces are tried in order of start and only a strictly better
score replaces one. A character that no piece covers alone scores `unk_penalty`
below the worst piece and counts as its UTF-8 bytes, or with byte_fallback off as
one piece for each run of such characters.

A text is cut where no piece can cross (before a run of spaces, around a line
feed), after checking that against the vocabulary; parts are counted one by one
and a bounded number of counts is kept for when a part comes again. Scores that
are whole numbers, as the ones the query uses, add up without rounding, so the cut
has no effect on the result.

Defined results: null or empty text has no tokens. Repeated rows are counted each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from quillon.llm.common import Texts, arrow_map, pick

SPACE = "\u2581"
CACHE_PARTS = 300_000


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], unk_penalty: float = 10.0, byte_fallback: bool = True, dummy_prefix: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unk = min(s for _, s in vocabulary) - unk_penalty
        self.byte_fallback, self.dummy_prefix = byte_fallback, dummy_prefix
        names = {p for p, _ in vocabulary}
        self.longest = max(map(len, names))
        parted = (SPACE in names or byte_fallback) and all(re.fullmatch(f"{SPACE}*[^{SPACE}]*", p) and ("\n" not in p or p == "\n") for p in names)
        self.parts = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if parted else r"(?s).+")
        if not byte_fallback:
            self.parts = re.compile(r"(?s).+")  # a run of unknown characters may go on across a line feed
        self.known: dict[str, int] = {}

    def part(self, text: str) -> int:
        """Pieces of the best split. What is kept is as long as the longest piece, however long the text."""
        size = self.longest + 1
        best, count, unknown = [0.0] * size, [0] * size, [False] * size
        found = self.automaton.iter(text)
        last, match = next(found, (-1, None))
        for end in range(1, len(text) + 1):
            here, top, alone = end % size, None, False
            ending = []
            while last == end - 1:
                ending.append(match)
                last, match = next(found, (-1, None))
            n = 0
            for length, score in sorted(ending, reverse=True) if len(ending) > 1 else ending:
                alone |= length == 1
                s = best[(end - length) % size] + score
                if top is None or s > top:
                    top, n = s, count[(end - length) % size] + 1
            before = (end - 1) % size
            is_unknown = False
            if not alone:
                s = best[before] + self.unk
                if top is None or s > top:
                    top, is_unknown = s, True
                    n = count[before] + (len(text[end - 1].encode()) if self.byte_fallback else not unknown[before])
            best[here], count[here], unknown[here] = top, n, is_unknown
        return count[len(text) % size]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if self.dummy_prefix:
            text = SPACE + text
        total, known = 0, self.known
        for m in self.parts.finditer(text):
            p = m[0]
            c = known.get(p)
            if c is None:
                c = self.part(p)
                if len(p) < 64:
                    if len(known) >= CACHE_PARTS:
                        known.clear()
                    known[p] = c
            total += c
        return total


def piece_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model and their scores."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=model_file)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size()) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i))]


_counters: dict[str, UnigramCounter] = {}


def token_counts(documents: DataFrame, model_file: str) -> DataFrame:
    """doc_id and n_tokens of each row, for the pieces and scores of model_file read as a unigram vocabulary."""

    def work(batch):
        if model_file not in _counters:
            _counters[model_file] = UnigramCounter(piece_vocabulary(model_file))
        count = _counters[model_file].count
        for i, j, data, offsets in Texts(batch["text"]).chunks():
            raw = data.tobytes()
            yield {"doc_id": batch["doc_id"].slice(i, j - i), "n_tokens": [count(raw[a:z].decode()) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]}

    return arrow_map(pick(documents, "doc_id", "text"), work, "doc_id long, n_tokens long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
