"""Text, archives and sound files; one task writes all files of a dictionary."""

from __future__ import annotations

import itertools
import os
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..codecs.audio import wav  # noqa: F401  (a sink of its own)


def dsl_lines(name: str, source: str, target: str, articles: Iterable[tuple[Iterable[str], str]]) -> Iterator[str]:
    """Header and articles of a text dictionary: the headings' lines, then the indented body."""
    yield f'#NAME\t"{name}"\r\n'
    yield f'#INDEX_LANGUAGE\t"{source}"\n'
    yield f'#CONTENTS_LANGUAGE\t"{target}"\n'
    for headings, body in articles:
        for h in headings:
            yield f"\n{h}"
        yield "\n\t" + body.replace("\n", "\n\t") + "\n"


def _replaced(path: str, parts: Iterable[bytes]) -> None:
    """The file appears when it is whole, so a task that runs again does no harm."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        for x in parts:
            f.write(x)
    os.replace(part, path)


def write_dsl(path: str, lines: Iterable[str]) -> None:
    """UTF-16 with a byte order mark."""
    _replaced(path, itertools.chain((b"\xff\xfe",), (line.encode("utf-16-le", "surrogatepass") for line in lines)))


def write_dictionaries(df: DataFrame, folder: str, group: str = "name", order: str = "first_ord", title: str | None = None) -> DataFrame:
    """Writes the articles (name, source, target, first_ord, headings, body) of each dictionary to a file; its name, path and number of articles.

    The file is named by ``group`` and has ``title`` (by default the same) as
    its name. Where there are columns annotation and icon, those of the first
    row are written beside it as ``.ann`` and ``.bmp``, unless they are null or
    empty. ``folder`` must be on a file system that every executor mounts.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        first = g.iloc[0]
        stem = os.path.join(folder, f"{first[group]}")
        write_dsl(f"{stem}.dsl", dsl_lines(first[title or group], first["source"], first["target"], zip(g["headings"], g["body"])))
        if first.get("annotation"):
            write_dsl(f"{stem}.ann", [first["annotation"]])
        if first.get("icon"):
            _replaced(f"{stem}.bmp", [bytes(first["icon"])])
        return pd.DataFrame({group: [first[group]], "path": [f"{stem}.dsl"], "articles": [len(g)]})

    return df.groupBy(group).applyInPandas(run, f"{group} string, path string, articles long")


def write_zip(path: str, files: Iterable[tuple[str, bytes]]) -> int:
    """Deflates the files; without one no archive is made."""
    n, archive = 0, None
    part = f"{path}.{os.getpid()}.part"
    for name, content in files:
        archive = archive or zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED)
        archive.writestr(name, content)
        n += 1
    if archive:
        archive.close()
        os.replace(part, path)
    return n
