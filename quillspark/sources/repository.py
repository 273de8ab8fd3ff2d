"""Item records of repositories (METS): licence and files; and predicates on member paths of archives."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(root: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    """Elements by local name: prefixes and namespaces differ between repositories."""
    return (e for e in root.iter() if e.tag.rpartition("}")[2] == name)


def _href(e: ElementTree.Element) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == "href"), None)


def licence(record: str) -> str:
    """The unqualified rights field of a record, "" if there is none."""
    fields = (e for e in _named(ElementTree.fromstring(record), "field") if e.get("element") == "rights" and e.get("qualifier") is None)
    return next((e.text.strip() for e in fields if e.text and e.text.strip()), "")


def bitstreams(record: str, base: str) -> dict[str, dict[str, object]]:
    """url, bytes and md5 of each file of a record that says where it is."""
    out: dict[str, dict[str, object]] = {}
    for e in _named(ElementTree.fromstring(record), "file"):
        href = next((h for child in reversed(list(e)) if child.tag.rpartition("}")[2] == "FLocat" and (h := _href(child))), _href(e))
        if href:
            url, size = urljoin(base, href), e.get("SIZE", "")
            md5 = e.get("CHECKSUM", "").lower() if e.get("CHECKSUMTYPE", "").upper() == "MD5" else None
            out[urlsplit(url).path.rpartition("/")[2]] = {"url": url, "bytes": int(size) if size.isdigit() else None, "md5": md5}
    return out


#: One row for each file of a record; one without a file for a record that has none, or that can't be read.
FILES = "licence string, name string, url string, bytes long, md5 string, error string"


def files(records: DataFrame, id_column: str = "id", record: str = "record", base: str = "base") -> DataFrame:
    """(id, licence, name, url, bytes, md5, error) of records (id, record, base); a record that is no XML says so."""
    names = [id_column, *[x.split()[0] for x in FILES.split(", ")]]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def rows(text: str | None, root: str) -> list[tuple]:
        try:
            right, found = licence(text or ""), bitstreams(text or "", root)
        except ElementTree.ParseError as e:
            return [(None, None, None, None, None, f"ParseError: {e}"[:500])]
        return [(right, name, x["url"], x["bytes"], x["md5"], None) for name, x in found.items()] or [(right, None, None, None, None, None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [rows(text, root or "") for text, root in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            owner = [k for k, own in enumerate(each) for _ in own]
            columns = list(zip(*[row for own in each for row in own], strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return records.select(id_column, record, base).mapInArrow(run, f"{id_column} {dict(records.dtypes)[id_column]}, {FILES}")


def without_licence(found: DataFrame, expected: str) -> DataFrame:
    """Records whose licence isn't, or no longer, the one that a registry says."""
    return found.where(F.col("error").isNull() & ~F.contains("licence", F.lit(expected)))


def require_licence(found: str, expected: str) -> str:
    if expected not in found:
        raise ValueError(f"the licence is now {found!r}, without {expected!r}")
    return found


def is_stm(path: Column, splits: tuple[str, ...] = ("train", "dev", "test")) -> Column:
    """split/transcriptions/stm/subset/recording.stm"""
    p = F.split(path, "/")
    return (F.size(p) >= 5) & p[0].isin(*splits) & (p[1] == "transcriptions") & (p[2] == "stm") & F.lower(path).endswith(".stm")


def is_audio(path: Column, splits: tuple[str, ...] = ("train", "dev", "test")) -> Column:
    """split/audio/subset/recording.wav"""
    p = F.split(path, "/")
    return (F.size(p) >= 4) & p[0].isin(*splits) & (p[1] == "audio") & F.lower(path).endswith(".wav")
