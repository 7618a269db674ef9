"""Finding, fetching and unpacking inputs (S8-S16 and S19 of the inventory)."""

from __future__ import annotations

import hashlib
import re
import shutil
import tarfile
import tempfile
import urllib.request
import uuid
import zipfile
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurekit.functions.text import is_url, name_from_uri

#: Suffixes of formats, and names in a folder that are metadata. Fixed values.
FORMATS = {".json": "geojson", ".geojson": "geojson", ".parquet": "geoparquet", ".geoparquet": "geoparquet"}
IGNORED = ("collection.json", "catalog.json")
CHUNK = 10 * 1024 * 1024
ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz", ".7z", ".rar")


def encoding_of(path: str | Path) -> str:
    """The format of a path, by its suffix."""
    found = FORMATS.get(Path(str(path)).suffix)
    if found is None:
        raise ValueError(f"Unsupported file format: {path}")
    return found


def expand(path: str | Path) -> list[str]:
    """A file or URL as it is; the supported files of a folder (not of those below it) in order of name."""
    if is_url(str(path)) or not Path(path).is_dir():
        return [str(path)]
    return sorted(str(p) for p in Path(path).iterdir() if p.is_file() and p.suffix.lower() in FORMATS and p.name not in IGNORED)


def parse_input(value: str) -> tuple[str, list[str] | None]:
    """ "uri|a,b" as an archive and the members wanted of it."""
    uri, bar, members = value.partition("|")
    return uri, [m.strip() for m in members.split(",") if m.strip()] if bar else None


def choose_sources(sources: str | Mapping | None, variants: Mapping[str, object] | None, variant: str | None) -> dict[str, object]:
    """URIs of a converter: its sources, or those of the variant (the first where none is named)."""
    if sources:
        found = sources
    elif variants:
        name = variant if variant is not None else next(iter(variants))
        if name not in variants:
            raise ValueError(f"Unknown variant '{name}'; choose from {', '.join(map(str, variants))}")
        found = variants[name]
    else:
        raise ValueError("No sources")
    return {found: name_from_uri(found)} if isinstance(found, str) else dict(found)


def cache_folder(folder: str | None = None) -> Path:
    path = Path(folder) if folder else Path(tempfile.mkdtemp(prefix="featurekit-"))
    path.mkdir(parents=True, exist_ok=True)
    return path


def shared_folder(spark: SparkSession) -> str | None:
    """A new folder that executors see too, beneath the checkpoint folder. Where there is none, executors that are threads
    of this machine see any folder (None); others could not, which is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base and re.match("(file:|/)", base):
        return f"{re.sub('^file:(//)?', '', base)}/featurekit-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder of a file system that the driver and all executors share")
    return None


def download(uris: Mapping[str, object], folder: str | None = None) -> list[tuple[str, str]]:
    """(local path, uri) of every wanted file: local ones in place, remote ones fetched once, archives unpacked once."""
    cache, out = cache_folder(folder), []
    for uri, target in uris.items():
        members = list(target) if isinstance(target, (list, tuple)) else None
        local = Path(uri)
        if is_url(uri):
            name = name_from_uri(uri) if members is None else (name_from_uri(uri) if Path(name_from_uri(uri)).suffix else hashlib.sha256(uri.encode()).hexdigest())
            local = cache / (target if isinstance(target, str) else name)
            if not local.exists():
                part = local.with_name(local.name + ".part")
                with urllib.request.urlopen(uri) as source, open(part, "wb") as f:  # noqa: S310
                    shutil.copyfileobj(source, f, CHUNK)
                part.rename(local)
        if members is None and not local.name.lower().endswith(ARCHIVES):
            out.append((str(local), uri))
            continue
        folder_of = unpack(local, cache)
        found = [folder_of / m for m in members] if members else sorted(p for p in folder_of.rglob("*") if p.is_file())
        out += [(str(p), uri) for p in found]
    return out


def unpack(archive: Path, cache: Path) -> Path:
    """The folder of an archive's content, made once. Members that would lie outside it are refused."""
    folder = cache / f"extracted.{archive.name}"
    if folder.exists():
        return folder
    work = Path(tempfile.mkdtemp(dir=cache))
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            if any(i.compress_type == 9 for i in z.infolist()):
                import zipfile_deflate64  # noqa: F401  adds the method to the module
            z.extractall(work)
    elif tarfile.is_tarfile(archive):
        with tarfile.open(archive) as t:
            t.extractall(work, filter="data")
    elif archive.suffix.lower() == ".7z":
        import py7zr

        with py7zr.SevenZipFile(archive) as z:
            z.extractall(work)
    elif archive.suffix.lower() == ".rar":
        import rarfile

        with rarfile.RarFile(str(archive)) as z:
            z.extractall(work)
    else:
        shutil.rmtree(work)
        raise ValueError(f"Unsupported archive: {archive}")
    work.rename(folder)
    return folder


def one_file(path: str) -> str:
    """The only file that a pattern matches; a path without "*" stays."""
    if "*" not in path:
        return path
    base = Path(path)
    found = sorted(base.parent.glob(base.name)) if "*" not in str(base.parent) else sorted(Path(base.anchor or ".").glob(str(base.relative_to(base.anchor or "."))))
    if len(found) != 1:
        raise ValueError(f"{path} matches {len(found)} files")
    return str(found[0])


def read_layers(spark: SparkSession, path: str, uri: str, keep: Callable[[str | None, str], bool] = lambda layer, uri: True, options: Mapping[str, str] | None = None) -> Iterable[tuple[DataFrame, str, str, str | None]]:
    """(frame, path, uri, layer) of every wanted layer of a file, geometry as a native column where the format has one."""
    from featurekit.functions.wkb import from_wkb
    from featurekit.sources import geojson, geoparquet, gpkg

    path = one_file(path)
    suffix = Path(path).suffix.lower()
    options = dict(options or {})
    if suffix in (".parquet", ".geoparquet"):
        yield (geoparquet.read_geoparquet(spark, path).df if geoparquet.footer(path, sums=False).geo else spark.read.parquet(path)), path, uri, None
    elif suffix in (".json", ".geojson"):
        yield geojson.read_flat(spark, path), path, uri, None
    elif suffix in (".geojsonl", ".ndjson", ".jsonl"):
        yield geojson.read_geojson(spark, path, lines=True).df, path, uri, None
    elif suffix in (".csv", ".tsv", ".txt"):
        yield spark.read.options(header=True, inferSchema=True, sep="\t" if suffix == ".tsv" else ",", **options).csv(path), path, uri, None
    elif suffix == ".gpkg":
        for layer in gpkg.layers(path):
            if keep(layer, uri):
                yield gpkg.read(spark, path, layer), path, uri, layer
    elif suffix == ".shp":
        from featurekit.sources import shapefile

        yield shapefile.read(spark, path), path, uri, None
    elif suffix == ".wkb":
        yield spark.read.format("binaryFile").load(path).select(from_wkb(F.col("content")).alias("geometry")), path, uri, None
    else:
        raise ValueError(f"Unsupported file format: {path}")
