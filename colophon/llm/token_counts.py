"""Token counts: map-side two-tier lookup.

Tier one is a compact table of the corpus's frequent pre-tokens with their numbers of tokens, broadcast
to every worker; tier two is a bounded cache in each worker, filled by encoding what tier one misses. No
pre-token is ever shuffled: counts are added up where the text is read.

A pre-token is a run of spaces or newlines and what follows up to the next; in a SentencePiece BPE model
whose pieces hold a space mark only at their start, and no newline, nothing merges across such a border
(`splits_exactly` checks the model), so the counts add up to the library's own. A model that fails the
check is applied to whole texts.

The table is an index that affects speed only, never a count, and it is fitted on a bounded sample: SAMPLE_DOCUMENTS
documents, drawn at random from SAMPLE_FILES files spread evenly over the table (from all rows where the
documents don't come from files), and written, so that all tasks read the texts. SAMPLE_TASKS tasks tally them; each passes on its TABLE_SIZE most frequent
pre-tokens at most, which the driver adds up to the TABLE_SIZE entries.

Defined results: a null text counts as empty and has 0 tokens; equal rows get equal counts; no
truncation: very long texts are counted whole; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import is_scan, slices, written
from colophon.llm.word_cache import WordCache, worker_cache

TABLE_SIZE, TALLY_LIMIT = 32768, 200_000
SAMPLE_DOCUMENTS, SAMPLE_FILES, SAMPLE_TASKS, SAMPLE_SEED = 20_000, 16, 16, 11
SPACE_MARK = "▁".encode()
PRE_TOKEN = re.compile(rb"[ \n]+[^ \n]*")


def pre_tokens(text: bytes) -> list[bytes]:
    return PRE_TOKEN.findall(b" " + text.replace(SPACE_MARK, b" "))


def splits_exactly(model) -> bool:
    """True if no piece of the model could join two pre-tokens."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return not any(re.search("[^▁]▁|\n| ", p) for p in pieces)


def length_of(model) -> Callable[[bytes], int]:
    """Tokens of a pre-token inside a text: those that it adds after a letter."""
    lead, encode = len(model.encode("a")), model.encode
    return lambda word: len(encode("a" + word.decode("utf-8", "replace"))) - lead


def _sample(documents: DataFrame) -> DataFrame:
    """About SAMPLE_DOCUMENTS texts. Only the chosen files are read: the filter on their names prunes the others."""
    files = sorted(documents.inputFiles()) if is_scan(documents) else []
    if len(files) > SAMPLE_FILES:
        names = [files[i * len(files) // SAMPLE_FILES].rpartition("/")[2] for i in range(SAMPLE_FILES)]
        documents = documents.filter(F.col("_metadata.file_name").isin([unquote(n) for n in names]))
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, documents.count()))
    texts = documents.select(F.col("text").cast("binary").alias("text"))
    return written(texts.filter(F.rand(SAMPLE_SEED) < share), "token-sample").coalesce(SAMPLE_TASKS)


def frequent_lengths(documents: DataFrame, model_path: str) -> dict[bytes, int]:
    """Frequent pre-tokens of the corpus and their numbers of tokens; at most TABLE_SIZE."""
    import sentencepiece

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(pre_tokens(text))
            if len(seen) > TALLY_LIMIT:
                seen = Counter(dict(seen.most_common(TALLY_LIMIT // 2)))
        best = [(w, n) for w, n in seen.most_common(TABLE_SIZE) if n > 1 and len(w) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.binary()), pa.array([n for _, n in best], pa.int64())], ["word", "n"])

    total: Counter = Counter()
    for batch in _sample(documents).mapInArrow(tally, "word binary, n long").toArrow().to_batches():
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[word] += n
    length = length_of(sentencepiece.SentencePieceProcessor(model_file=model_path))
    return {w: length(w) for w, _ in total.most_common(TABLE_SIZE)}


def count_tokens(documents: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than `limit`) of every document."""
    import sentencepiece

    exact = splits_exactly(sentencepiece.SentencePieceProcessor(model_file=model_path))
    table = documents.sparkSession.sparkContext.broadcast(frequent_lengths(documents, model_path) if exact else {})

    key = uuid.uuid4().hex  # workers outlive a query; their cache must not outlive its table

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        cache = worker_cache(key, lambda: WordCache(length_of(model), table.value))
        known = cache.__getitem__
        for batch in slices(batches):
            counts: list[int] = []
            texts = batch.column(1).to_pylist()
            for t in texts:
                if not t:
                    counts.append(0)
                elif exact:
                    counts.append(sum(map(known, pre_tokens(t))))
                    cache.turn()
                else:
                    counts.append(len(model.encode(t.decode("utf-8", "replace"))))
            sizes = [len(t or b"") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
