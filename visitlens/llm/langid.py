"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of
labelled texts. A text is encoded with every language's dictionary, whole, in blocks
small enough that the dictionary and not the text's own past decides; the language with
the smallest encoding wins. Texts are lower-cased, reduced to letters and to distinct
words in order first, so that shouting, tables and repeated words do not blur the sizes.

A text is rejected if no letter is in it, or if the margin between the two smallest
encodings is narrow although there are letters enough to tell.

Defined results: null, empty and letterless texts get ``und``, score 0, rejected; ties
go to the first language by name; with nothing to learn from, all is ``und``; repeated
rows are judged alike; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back

BLOCK = 4096
LEVEL = 6
#: the coder stores tiny inputs as they are; texts under SHORT bytes are encoded behind
#: PAD bytes of each dictionary, less what those take alone
SHORT, PAD = 256, 512
UNKNOWN = "und"
#: all bytes but ASCII lower-case letters and those of longer characters become blanks
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised(text: str) -> bytes:
    """The distinct words of letters, lower-cased, in order of appearance."""
    return b" ".join(dict.fromkeys(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()))


def learn(rows: DataFrame, sample_docs: int = 400, dictionary_bytes: int = 65_536, doc_bytes: int = 2_000) -> dict[str, bytes]:
    """Rows of (doc_id, text, lang) -> a dictionary per language, from at most
    ``sample_docs`` rows of each, picked by a hash of doc_id, until it is full. Of each,
    a stretch at a place given by a hash; words that the dictionary has already are left
    out, so texts that open alike or are copies take no room. One pass over the texts;
    the driver receives no more than the dictionaries' raw material."""
    rows = rows.where("lang is not null and text rlike '\\\\p{L}'").select("doc_id", "text", "lang")
    pick, room = F.xxhash64("doc_id"), 4 * doc_bytes
    many = rows.groupBy("lang").count().collect()  # a dictionary each follows
    if not many:
        return {}
    # a hash threshold that leaves about four times the sample of each language
    shares = F.create_map(*[F.lit(x) for lang, n in many for x in (lang, min(1.0, (4.0 * sample_docs + 20) / n))])
    rows = rows.where(F.pmod(pick, F.lit(1 << 30)) < shares[F.col("lang")] * (1 << 30))
    place = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.char_length("text") - room + 1)).cast("int")
    picked = rows.select("doc_id", "lang", F.col("text").substr(place + 1, F.lit(room)).alias("text"))
    picked = picked.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(pick, "doc_id", "text"))).where(F.col("nth") <= sample_docs)
    out: dict[str, dict[bytes, None]] = {}
    size: dict[str, int] = {}
    for r in picked.orderBy("lang", "nth").toLocalIterator():
        words = out.setdefault(r.lang, {})
        for w in normalised(r.text)[:doc_bytes].split():
            if w not in words and size.get(r.lang, 0) < dictionary_bytes:
                words[w] = None
                size[r.lang] = size.get(r.lang, 0) + len(w) + 1
    return {k: (b" ".join(v) + b" ")[:dictionary_bytes] for k, v in sorted(out.items()) if v}


def encoded_sizes(data: bytes, coders: list, pads: list[tuple[bytes, int]]) -> list[int]:
    """Bytes that each language's coder takes for the normalised text."""
    if len(data) < SHORT:
        return [len(c.compress(pad + data)) - alone for c, (pad, alone) in zip(coders, pads)]
    sizes = [0] * len(coders)
    for lo in range(0, len(data), BLOCK):
        part = data[lo : lo + BLOCK]
        for k, c in enumerate(coders):
            sizes[k] += len(c.compress(part)) - 6
    return sizes


def _compressors(dictionaries: dict[str, bytes], level: int) -> list:
    import zstandard as z

    out = []
    for content in dictionaries.values():
        params = z.ZstdCompressionParameters.from_level(
            level, dict_size=len(content), source_size=BLOCK, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append(z.ZstdCompressor(compression_params=params, dict_data=d))
    return out


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL, min_margin: float = 0.01, min_letters: int = 64, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, or the columns of ``carry`` as the struct ``row``, whatever their names;
    lang_pred, score, margin and rejected. Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # dictionary_bytes a language
    names = list(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _compressors(shared.value, level)
        pads = [(d[:PAD] + b" ", len(c.compress(d[:PAD] + b" "))) for c, d in zip(made, shared.value.values())]
        for batch in batches:
            lang, score, margin, rejected = [], [], [], []
            for value in batch.column(0):
                data = normalised(value.as_py() or "")
                letter = any(c >= 128 for c in data) and any(ch.isalpha() for ch in data.decode("utf-8", "replace")) or any(97 <= c <= 122 for c in data[:64])
                if not letter or not made:
                    row = (UNKNOWN, 0.0, 0.0, True)
                else:
                    sizes = encoded_sizes(data, made, pads)
                    order = sorted(range(len(made)), key=lambda k: (sizes[k], k))
                    best, second = sizes[order[0]], sizes[order[1]] if len(order) > 1 else len(data)
                    m = max(0.0, (second - best) / max(1, second))
                    # margin 0 is a coin toss, a tenth is all but certain
                    row = (names[order[0]], 1.0 - 0.5 * 2.0 ** (-m / 0.02), m, m < min_margin and len(data) >= min_letters)
                for out, v in zip((lang, score, margin, rejected), row):
                    out.append(v)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[f.name for f in schema],
            )
        give_back()

    rows = docs.select("text", F.struct(*carry).alias("row") if carry else F.col("doc_id"))
    schema = (
        rows.drop("text")
        .withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0), "margin": F.lit(0.0), "rejected": F.lit(False)})
        .schema
    )
    return rows.mapInArrow(run, schema)
