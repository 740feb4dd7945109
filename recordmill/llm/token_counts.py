"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

The forward score of a prefix (best total score, then fewest tokens) depends on that prefix alone. Distinct pre-tokens
are inserted in a trie, a prefix is scored when its node is made, and the token count at a terminal node is the
pre-token's. A task keeps its trie from batch to batch and starts a new one beyond ``MOST_NODES`` nodes, and
what follows the first ``DEPTH`` characters of a pre-token is scored without nodes, so both bound its memory.

Nothing is trained. The public vocabulary file lists its pieces by merge rank and has no probabilities, so a piece of
rank r gets the unigram log-probability -log(r) - log(H), by Zipf's law, H being the sum of 1/r over the vocabulary; they
add up to 1. Counts are therefore those of a unigram model over this vocabulary, not of the file's own merges.

Pre-tokens are runs between white space, written with U+2581 before them. A character outside the vocabulary counts as
one token per UTF-8 byte, each ``UNKNOWN`` below the least likely piece. Null or empty text has none. Repeated rows get
equal counts; ids pass through, nulls too; other columns are ignored; an empty table gives no rows.
"""

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN = 10.0
MOST_NODES = 1_000_000
#: Characters of a word that get nodes; what follows them is scored from the last prefixes alone, in constant memory.
DEPTH = 1000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_scores(path: str | None = None) -> dict[str, float]:
    """Piece to unigram log-probability; a fixed file, so its size is bounded."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    pieces = [(-sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    norm = math.log(math.fsum(1 / r for r in range(1, len(pieces) + 1)))
    return {sp.id_to_piece(i): -math.log(r) - norm for r, (_, i) in enumerate(sorted(pieces), 1)}


class Trie:
    """Prefixes with their best score and its number of tokens; node 0 is the empty prefix."""

    def __init__(self, scores: dict[str, float], longest: int, unknown: float):
        self.scores, self.longest, self.unknown = scores, longest, unknown
        self.children: list[dict[str, int]] = [{}]
        self.best, self.count = [0.0], [0]

    def insert(self, word: str) -> int:
        """The token count of ``word``; of its first ``DEPTH`` prefixes only those that no earlier word has are scored."""
        path, get = [0], self.scores.get
        for end, letter in enumerate(word[:DEPTH], 1):
            node = self.children[path[-1]].get(letter)
            if node is None:
                n = len(letter.encode("utf-8", "surrogatepass"))
                top, fewest = self.best[path[-1]] + self.unknown * n, self.count[path[-1]] + n
                for start in range(max(0, end - self.longest), end):
                    s = get(word[start:end])
                    if s is not None:
                        value, k = self.best[path[start]] + s, self.count[path[start]] + 1
                        if value > top or (value == top and k < fewest):
                            top, fewest = value, k
                node = self.children[path[-1]][letter] = len(self.best)
                self.children.append({})
                self.best.append(top)
                self.count.append(fewest)
            path.append(node)
        return self.count[path[-1]] if len(word) <= DEPTH else self._beyond(word, path)

    def _beyond(self, word: str, path: list[int]) -> int:
        """The token count of a word that goes on after the nodes of ``path``."""
        get, last = self.scores.get, deque([(self.best[n], self.count[n]) for n in path], self.longest or 1)
        for end in range(len(path), len(word) + 1):
            n = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top, fewest = last[-1][0] + self.unknown * n, last[-1][1] + n
            for back, (value, k) in enumerate(reversed(last), 1):
                s = get(word[end - back : end])
                if s is not None and (value + s > top or (value + s == top and k + 1 < fewest)):
                    top, fewest = value + s, k + 1
            last.append((top, fewest))
        return last[-1][1]


def count_words(words: list[str], scores: dict[str, float], longest: int, unknown: float) -> dict[str, int]:
    """Terminal counts of distinct words."""
    trie = Trie(scores, longest, unknown)
    return {w: trie.insert(w) for w in words}


def token_counts(spark: SparkSession, docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_pretokens`` and ``n_tokens`` per row."""
    scores = load_scores(path)
    longest = max(map(len, scores), default=1)
    unknown = min(scores.values(), default=0.0) - UNKNOWN
    shared = spark.sparkContext.broadcast((scores, longest, unknown))  # the vocabulary: tens of thousands of pieces

    @F.pandas_udf("n_pretokens long, n_tokens long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie, known = Trie(*shared.value), {}
        for texts in batches:
            if len(trie.best) > MOST_NODES:
                trie, known = Trie(*shared.value), {}
            split = [t.split() for t in texts.fillna("")]
            for words in split:
                for w in words:
                    if w not in known:
                        known[w] = trie.insert(SPACE + w)
            get = known.__getitem__
            yield pd.DataFrame({"n_pretokens": [len(w) for w in split], "n_tokens": [sum(map(get, w)) for w in split]})
            for w in [w for w in known if len(w) > DEPTH]:  # few nodes stand for them, so they aren't kept
                del known[w]

    own = docs.select(F.col(id_col), run(F.col(text_col).cast("string")).alias("r"))
    return own.select(id_col, "r.*")
