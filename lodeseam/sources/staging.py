"""The staging folder: confined paths, archives, and which pages are still to be fetched. Fetching itself is left to the caller."""

from __future__ import annotations

import os
import tarfile
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relative(path: str) -> str:
    """A clean relative path; absolute ones and those that climb are refused."""
    p = PurePosixPath(path.replace("\\", "/"))
    if p.is_absolute() or ".." in p.parts or (p.parts and p.parts[0].endswith(":")):
        raise ValueError(f"unsafe path: {path}")
    return str(p)


def within(child: str | os.PathLike, parent: str | os.PathLike) -> bool:
    return Path(child).resolve().is_relative_to(Path(parent).resolve())


def joined(base: str | os.PathLike, rel: str) -> Path:
    out = Path(base) / relative(rel)
    if not within(out, base):
        raise ValueError(f"{rel} leaves {base}")
    return out.resolve()


def unpack(archive: str, into: str, version: str) -> bool:
    """Unpack a tar archive unless this version is there already. Links, devices and members that leave the folder are dropped."""
    mark = Path(into) / ".version"
    if mark.exists() and mark.read_text() == version:
        return False
    Path(into).mkdir(parents=True, exist_ok=True)
    with tarfile.open(archive) as tar:
        for m in tar:
            if not (m.isfile() or m.isdir()):
                continue
            try:
                to = joined(into, m.name)
            except ValueError:
                continue
            if m.isdir():
                to.mkdir(parents=True, exist_ok=True)
            else:
                to.parent.mkdir(parents=True, exist_ok=True)
                with tar.extractfile(m) as src, to.open("wb") as out:
                    while block := src.read(1 << 20):
                        out.write(block)
    mark.write_text(version)
    return True


def post_urls(index: DataFrame, html_col: str = "html", most: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """pos, url after the columns to keep: links of the form /YYYY/MM/DD/slug.html of a blog's index page, each once, in order of first occurrence."""
    hrefs = F.regexp_extract_all(html_col, F.lit(r"""href\s*=\s*["']?(/[0-9]{4}/[0-9]{2}/[0-9]{2}/[^/"'\s>]+\.html)["'\s>]"""), F.lit(1))
    urls = F.array_distinct(hrefs)
    return index.select(*keep, F.posexplode(F.slice(urls, 1, most) if most is not None else urls).alias("pos", "url"))


def to_fetch(urls: DataFrame, cached: DataFrame, force: bool = False) -> DataFrame:
    return urls if force else urls.join(cached.select("url"), "url", "left_anti")
