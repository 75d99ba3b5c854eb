"""Sinks and artifacts: tables, JSON lines, CSV, text files and word-processor files, all byte-stable."""

from __future__ import annotations

import json
import os
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


HASH_BUCKETS = 65_536


def content_hash(df: DataFrame) -> DataFrame:
    """One hash of all rows, whatever their order: rows are hashed, added up inside buckets by their first digits, and the sums hashed in order of bucket.

    Sums are of four pieces of a row's hash and need no order, so a bucket is combined in the map tasks
    and the last step sees at most HASH_BUCKETS rows. A null field is not the same as an empty one.
    """
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in df.columns)), 256)
    piece = lambda i: F.conv(F.substring("h", 16 * i + 1, 15), 16, 10).cast("decimal(38,0)")
    rows = df.select(row.alias("h")).select(F.left("h", F.lit(4)).alias("bucket"), *(piece(i).alias(f"p{i}") for i in range(4)))
    sums = rows.groupBy("bucket").agg(F.count("*").alias("n"), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(4)))
    spelled = F.concat_ws(":", "bucket", F.col("n").cast("string"), *(F.col(f"p{i}").cast("string") for i in range(4)))
    return sums.agg(F.array_join(F.array_sort(F.collect_list(spelled)), "|").alias("all")).select(F.sha2("all", 256).alias("corpus_sha256"))


def write_sorted(df: DataFrame, path: str, keys: list[str]) -> None:
    """A Parquet table, ranged and sorted by keys, so readers prune by their statistics."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str, keys: list[str]) -> None:
    df.orderBy(*keys).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, keys: list[str]) -> None:
    df.orderBy(*keys).write.mode("overwrite").csv(path, header=True, nullValue="")


def replace_file(path: str, data: bytes) -> None:
    """The file appears whole or not at all."""
    with open(f"{path}.tmp", "wb") as f:
        f.write(data)
    os.replace(f"{path}.tmp", path)


def stable_json(value: object) -> bytes:
    return (json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode()


def markdown(lines: DataFrame, title: str) -> bytes:
    """The rendered index: lines (letter, ord, line) of a finished index, which is small."""
    rows = lines.orderBy("letter", "ord").select("line").collect()
    return ("\n".join([f"# {title}", "", *(r["line"] for r in rows)]) + "\n").encode()


#: Parts of a minimal word-processor file.
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def docx(lines: DataFrame, path: str, title: str) -> None:
    """The same lines as a word-processor file with fixed timestamps and order of parts."""
    rows = [title, *(r["line"] for r in lines.orderBy("letter", "ord").select("line").collect())]
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in rows)
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    with zipfile.ZipFile(f"{path}.tmp", "w") as z:
        for name, data in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", document)):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    os.replace(f"{path}.tmp", path)
