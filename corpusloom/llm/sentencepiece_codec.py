"""SentencePiece encoding and decoding over tables of distinct marked words.

Where no piece of the vocabulary holds a whitespace marker behind another character, no merge crosses the
start of a marked word (a run of markers and the characters up to the next one), so a text's ids are the ids
of its marked words in a row. Each task keeps a table of the distinct marked words it has met; a word is
segmented once, and texts are put together from the table by position. A table that all tasks share would need
a join of every word of the corpus, which moves more than the budget allows, so tables live in the tasks. The
table is emptied at `MAX_WORDS` entries: that bounds memory and changes no result.

Null and empty texts have no ids and decode to an empty text. Ids and text agree with the library's encode and
decode, without begin or end ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
MAX_WORDS = 400_000


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_are_closed(processor) -> bool:
    """Whether no piece holds a marker after another character, which the word table relies on."""
    return not any(re.search(f"[^{MARK}]{MARK}", processor.id_to_piece(i)) for i in range(processor.get_piece_size()))


class WordTable:
    """Distinct marked words with their ids as text and what they decode to."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        if not words_are_closed(self.processor):
            raise ValueError("pieces of this model cross whitespace markers")
        # An isolated marker cannot be asked for as a text, since the library adds one in front by itself.
        self.mark = self.processor.piece_to_id(MARK)
        self.split = re.compile(" *[^ ]+| +").findall
        self.names = [str(i) for i in range(self.processor.get_piece_size())]
        # Words go without the marker they start with.
        self.ids: dict[str, str] = {}
        self.changed: dict[str, str] = {}  # what a word decodes to, where that is not the word itself

    def learn(self, words: set[str]) -> None:
        """Segment new words, each of which starts with the marker that the library puts in front."""
        if len(self.ids) + len(words) > MAX_WORDS:
            self.ids.clear()
            self.changed.clear()
        new = list(words.difference(self.ids))
        encoded = [ids or [self.mark] for ids in self.processor.encode(new, num_threads=1)]
        # decode() drops the first marker: one more in front keeps the word's own.
        decoded = self.processor.decode([[self.mark, *ids] for ids in encoded], num_threads=1)
        for word, ids, text in zip(new, encoded, decoded, strict=True):
            self.ids[word] = ",".join(map(self.names.__getitem__, ids))
            if text != f" {word}":
                self.changed[word] = text

    def words(self, marked: str) -> list[str]:
        """The marked words of a text with a marker in front; most texts hold single markers between words."""
        if "  " in marked or marked.endswith(" "):
            return [word[1:] for word in self.split(marked)]
        return marked[1:].split(" ")

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """Ids joined by commas, and the decoded text, of each text."""
        marked = [" " + t.replace(MARK, " ") if t else "" for t in texts]
        split = [self.words(m) if m else [] for m in marked]
        self.learn(set().union(*split))
        for whole, words in zip(marked, split, strict=True):
            ids = ",".join(map(self.ids.__getitem__, words))
            if not self.changed or self.changed.keys().isdisjoint(words):
                yield ids, whole[1:]
            else:
                yield ids, "".join([self.changed.get(word, f" {word}") for word in words])[1:]


def encoder(path: str | None = None, ids_as_lists: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(path or model_file())
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                pairs = list(table.encode(part.column("text").to_pylist()))
                counts = [ids.count(",") + 1 if ids else 0 for ids, _ in pairs]
                if ids_as_lists:
                    values = [[int(x) for x in ids.split(",")] if ids else [] for ids, _ in pairs]
                    out = [pa.array(values, pa.list_(pa.int32())), pa.array([t for _, t in pairs], pa.string())]
                else:
                    out = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in side]) for side in zip(*pairs, strict=True)]
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names] + [pa.array(counts, pa.int64()), *out],
                    names=[*names, "n_tokens", *(("ids", "decoded") if ids_as_lists else ("ids_sha256", "decoded_sha256"))],
                )

    return run


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text of every document."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(encoder(path), schema)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document."""
    schema = "doc_id long, n_tokens long, ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(encoder(path, ids_as_lists=True), schema)
