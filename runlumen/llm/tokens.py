"""Token counts of whole texts without materialising token ids.

A text falls into pre-tokens that no piece of the vocabulary can span, so the pieces of a text are
the pieces of its pre-tokens. Each task counts the pieces of every distinct pre-token once, joins
these counts to the frequencies of the pre-tokens in its documents and adds them up per document.
The join stays inside the task: pre-token pairs of all documents are far larger than the documents
themselves, and a vocabulary of words grows with the corpus, so neither is shuffled or broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlumen.llm.common import pieces, texts_of

#: Distinct pre-tokens whose counts a task keeps (about 100 bytes each) before it starts afresh.
KEPT = 400_000
#: Text bytes a task works on at once.
CHUNK = 8 << 20
#: The sign that stands for a space in pieces.
SPACE = "▁"


class PieceCounter:
    """Counts pieces of pre-tokens with a sentencepiece model, each distinct one once.

    Needs a model whose pieces hold the space sign at their start only and whose normalizer leaves
    text as it is but for a space put before it; anything else raises an error, since then the
    pieces of a text are not those of its parts.
    """

    def __init__(self, path: str, kept: int = KEPT) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())
                 if not self.model.is_byte(i) and not self.model.is_control(i)
                 and not self.model.is_unknown(i)]
        probe = "  ﬁ ①　é  x   "
        same = self.model.normalize(probe) == (SPACE + probe).replace(" ", SPACE)
        if not same or any(SPACE in n.lstrip(SPACE) for n in names):
            raise ValueError("pieces of this model do not follow pre-tokens")
        if any("\n" in n for n in names) or len(self.model.encode("\n")) != 2:
            raise ValueError("line breaks are not pieces of their own in this model")
        self.split = re.compile(f"[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+|\n").findall
        self.kept, self.counts = kept, {}
        self.base = 2  # pieces of a line break that starts a text

    def encode(self, tokens: list[str]) -> list[int]:
        """Pieces of each pre-token, none of which stands at the start of a text.

        A pre-token that starts with a space sign loses one, as encoding puts one before it; any
        other one is counted behind a line break, which is pieces of its own.
        """
        given = [t[1:] if t[0] in (" ", SPACE) else "\n" + t for t in tokens]
        found = self.model.encode(given, num_threads=1)
        alone = self.base - 1  # a space sign by itself
        return [alone if t in (" ", SPACE) else len(ids) - (0 if t[0] in (" ", SPACE) else self.base)
                for t, ids in zip(tokens, found, strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        frequencies = [Counter(self.split(" " + t)) if t else Counter() for t in texts]
        if len(self.counts) > self.kept:
            self.counts = {}
        counts = self.counts
        fresh = list({p for f in frequencies for p in f if p not in counts})
        counts.update(zip(fresh, self.encode(fresh), strict=True))
        return [sum(n * counts[p] for p, n in f.items()) for f in frequencies]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, kept: int = KEPT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document.

    ``docs`` needs doc_id and text; other columns are not read. Null and empty texts have 0 bytes and
    0 tokens; repeated rows are counted each; a null doc_id stays null. ``model_path``: a
    sentencepiece model every executor can read.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_path, kept)
        for batch in pieces(batches, "text", CHUNK):
            tokens = pa.array(counter.count(texts_of(batch, "text")), pa.int64())
            sizes = pa.compute.binary_length(batch["text"]).fill_null(0).cast(pa.int64())
            over = pa.compute.greater(tokens, limit)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], sizes, tokens, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
