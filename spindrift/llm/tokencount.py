"""Token counts without tokens: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a text; dynamic programming over
the ends of matches carries the best score and the number of pieces of the best path, no path.
The rules are those of the ``tokenizers`` library's Unigram model with byte fallback after Metaspace:
among equal scores at one place the piece that starts first wins, a character of no piece of its
own may also be unknown at the least score less ten, and it then counts one piece for each byte.

The box has no unigram vocabulary; ``piece_bpe_32k.model``'s pieces and scores serve as one, without
its control pieces.  Each distinct word of a batch is counted once.  Null and empty texts have no
tokens; texts count whole, however long; repeated rows each count, and count the same.  A column named like
the count's is replaced, others stay; an empty table has no counts.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bytewords as bw
from spindrift.llm.common import appended, table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Stands between words; no UTF-8 text holds it.
_END = "\ud800"
#: The unknown piece's own string, which no text is expected to hold.
UNKNOWN = "\uffff<unknown>\uffff"
#: Words that a worker remembers between batches.
REMEMBERED = 400_000

_RUN = np.ones(256, dtype=bool)
_RUN[0x20] = False


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """(piece, score) of a SentencePiece file; the unknown piece comes first."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return ((UNKNOWN, 0.0), *((m.id_to_piece(k), m.get_score(k)) for k in range(m.get_piece_size()) if not m.is_control(k) and not m.is_unknown(k)))


class Counter:
    def __init__(self, pieces: tuple[tuple[str, float], ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def _counted(self, words: list[str]) -> list[int]:
        text = _END.join(words) + _END
        n = len(text)
        score: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        score[0], done, single, unknown = 0.0, 0, self.single, self.unknown
        out = []

        def finish(upto: int) -> None:
            """All pieces that end before upto are in: what is left of these places are unknown characters and ends of words."""
            nonlocal done
            while done < upto:
                c = text[done]
                if c == _END:
                    out.append(count[done])
                    score[done + 1], count[done + 1] = 0.0, 0
                elif c not in single:
                    s = score[done] + unknown
                    if score[done + 1] is None or s > score[done + 1]:
                        score[done + 1], count[done + 1] = s, count[done] + len(c.encode())
                done += 1

        for end, (length, value) in self.automaton.iter(text):
            if end > done:
                finish(end)
            at = end + 1 - length
            s = score[at] + value
            old = score[end + 1]
            if old is None or s > old:
                score[end + 1], count[end + 1] = s, count[at] + 1
        finish(n)
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """Pieces of each word."""
        new = [w for w in words if w not in self.known]
        own = dict(zip(new, self._counted(new))) if new else {}
        out = np.fromiter((own[w] if w in own else self.known[w] for w in words), np.int64, len(words))
        if len(self.known) + len(own) <= REMEMBERED:
            self.known |= own
        return out

    def text(self, text: str) -> int:
        """Pieces of one text, the plain way."""
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        return int(self.words([SPACE + w for w in (text if text.startswith(SPACE) else SPACE + text).split(SPACE)[1:]]).sum())

    def column(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column), np.int64)
        for a, b, data, at in bw.chunks(column):
            raw = data.tobytes()
            starts, ends, first = bw.spans(data, at, _RUN)
            _, where, which = np.unique(bw.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            distinct = [SPACE + raw[starts[k] : ends[k]].decode() for k in where]
            pieces = self.words([SPACE, *distinct])
            runs = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(pieces[1:][which], out=runs[1:])
            spaces = np.zeros(len(data) + 1, np.int64)
            np.cumsum(data == 0x20, out=spaces[1:])
            full = np.diff(at) > 0
            words = np.zeros(b - a, np.int64)
            words[full] = (spaces[at[1:]] - spaces[at[:-1]])[full] + (data[at[:-1][full]] != 0x20)
            out[a:b] = runs[first[1:]] - runs[first[:-1]] + (words - np.diff(first)) * pieces[0]
            if SPACE.encode() in raw:
                for r in range(a, b):
                    own = raw[at[r - a] : at[r - a + 1]]
                    if SPACE.encode() in own:
                        out[r] = self.text(own.decode())
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def counted(documents: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """documents with n_tokens; a column of that name is replaced."""
    path = path or default_path()
    return appended(documents, lambda batch: {"n_tokens": pa.array(counter(path).column(batch.column(text)))}, "n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_tokens")


QUERIES = {"op7_token_counts": op7_token_counts}
