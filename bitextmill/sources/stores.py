"""Memory files (SQLite), checker models and project packages (zip), and the quality report."""

from __future__ import annotations

import csv
import html
import io
import json
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import workers
from ..schemas import TM_MAIN


def version_of(text: str | None) -> tuple[int, int, int]:
    parts = [int(x) for x in (text or "0.0.1").split("-")[0].split(".")]
    return tuple([*parts, 0, 0, 0][:3])


def memory_lines(content: bytes) -> Iterator[tuple]:
    """(source language, target language, version, row) of a memory file; columns that older files lack are null. A file without
    rows gives one null row."""
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "memory")
        path.write_bytes(content)
        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        try:
            meta = con.execute("SELECT * FROM metadata").fetchone() or (None, None)
            have = [c[1] for c in con.execute("PRAGMA table_info(main)")]
            names = [c for c in ("id", "source", "target", "state", "time", "submitted_by") if c in have]
            languages, empty = (meta[0], meta[1], meta[2] if len(meta) > 2 else "0.0.1"), True
            for r in con.execute(f"SELECT {', '.join(names)} FROM main ORDER BY rowid"):
                empty = False
                yield *languages, dict.fromkeys(("id", "source", "target", "state", "time", "submitted_by")) | dict(zip(names, r))
            if empty:
                yield *languages, None
        finally:
            con.close()


def memory_rows(content: bytes) -> dict:
    """Languages, version and rows of a memory file."""
    found = list(memory_lines(content))
    return dict(zip(("src", "trg", "version"), found[0])) | {"rows": [r[3] for r in found if r[3] is not None]}


class MemoryFile:
    """A memory file that is written row by row."""

    def __init__(self, src: str, trg: str, version: str = "0.16.0"):
        self.folder = tempfile.TemporaryDirectory()
        self.path, self.n = Path(self.folder.name, "memory"), 0
        self.con = sqlite3.connect(self.path)
        self.con.execute("CREATE TABLE metadata (source TEXT, target TEXT, version TEXT)")
        self.con.execute("INSERT INTO metadata VALUES (?, ?, ?)", (src, trg, version))
        self.con.execute("CREATE TABLE main (id INTEGER PRIMARY KEY AUTOINCREMENT, source TEXT, target TEXT, state TEXT, time TEXT, submitted_by TEXT)")

    def add(self, rows: list[tuple]) -> None:
        self.con.executemany("INSERT INTO main VALUES (?, ?, ?, ?, ?, ?)", rows)
        self.n += len(rows)

    def content(self) -> bytes:
        self.con.commit()
        self.con.close()
        with self.folder:
            return self.path.read_bytes()


def memory_bytes(rows: list[tuple], src: str, trg: str, version: str = "0.16.0") -> bytes:
    """A memory file of rows (id, source, target, state, time, submitted_by)."""
    file = MemoryFile(src, trg, version)
    file.add(rows)
    return file.content()


def read_memories(files: DataFrame, src: str | None = None, trg: str | None = None) -> DataFrame:
    """Rows of memory files (file_id, content) with their file's languages and version.

    If both languages are given, files of another pair are an error.
    """

    def run(file_id, content):
        for a, b, version, row in memory_lines(content):
            if src and trg and (a, b) != (src, trg):
                raise ValueError(f"the file is for {a} to {b}")
            if row is not None:
                yield file_id, a, b, version, *row.values()

    return workers.mapped(files.select("file_id", "content"), run, f"file_id string, src_lang string, trg_lang string, version string, {TM_MAIN}")


def write_memories(rows: DataFrame, src: str, trg: str, version: str = "0.16.0", most: int = 100_000) -> DataFrame:
    """(file_id, part, content): memory files for each file_id of ``rows`` (file_id and the columns of a memory).

    A file is one SQLite database of at most ``most`` rows in id order; a larger memory is several files, ``part`` 1, 2, ...
    Rows go from the sorted partition to the database as they come, so a task holds one file and a batch.
    """
    bounded = workers.sorted_groups(rows.select("file_id", "id", "source", "target", "state", "time", "submitted_by"), ["id"])

    def run(batches):
        name, part, file = None, 0, None
        done = lambda: pa.RecordBatch.from_pydict({"file_id": [name], "part": [part], "content": [file.content()]}, pa.schema([("file_id", pa.string()), ("part", pa.int32()), ("content", pa.binary())]))
        for batch in batches:
            for found, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if file is not None and (found != name or file.n >= most):
                    yield done()
                    part, file = part if found == name else 0, None
                if file is None:
                    name, part, file = found, part + 1, MemoryFile(src, trg, version)
                file.add([tuple(row)])
        if file is not None:
            yield done()

    return bounded.mapInArrow(run, "file_id string, part int, content binary")


# checker models


def model_bytes(letters: list[str], counts: list[tuple[str, int]]) -> bytes:
    out, table = io.BytesIO(), io.StringIO()
    csv.writer(table).writerows(sorted(counts, key=lambda x: (-x[1], x[0])))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("letters.txt", "".join(sorted(letters)))
        z.writestr("word_counter.csv", table.getvalue())
    return out.getvalue()


def read_model(spark: SparkSession, content: bytes) -> tuple[DataFrame, DataFrame]:
    """(letters, words) of a checker model file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        letters = sorted(set(z.read("letters.txt").decode("utf-8")) - {"\n"})
        rows = [(w, int(n)) for w, n in csv.reader(io.StringIO(z.read("word_counter.csv").decode("utf-8")))]
    return spark.createDataFrame([(x,) for x in letters], "letter string"), spark.createDataFrame(rows, "word string, count long")


def read_models(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_id, letter) and (file_id, word, count) of checker model files (file_id, content)."""

    def letters(file_id, content):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for x in sorted(set(z.read("letters.txt").decode("utf-8")) - {"\n"}):
                yield file_id, x

    def words(file_id, content):
        with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("word_counter.csv") as raw:
            for w, n in csv.reader(io.TextIOWrapper(raw, "utf-8", newline="")):
                yield file_id, w, int(n)

    given = files.select("file_id", "content")
    return workers.mapped(given, letters, "file_id string, letter string"), workers.mapped(given, words, "file_id string, word string, count long")


def write_models(letters: DataFrame, words: DataFrame) -> DataFrame:
    """(file_id, content) of checker models from (file_id, letter) and (file_id, word, count); without letters there is no model.

    A model is one file, so its words meet in one task, sorted; they go into the file as they come, none is held.
    """
    every = letters.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("letter")), "").alias("letters"))
    first = every.select("file_id", F.lit(None).cast("long").alias("_less"), F.lit(None).cast("string").alias("word"), "letters")
    rows = first.unionByName(words.select("file_id", (-F.col("count")).alias("_less"), "word", F.lit(None).cast("string").alias("letters")))
    given = workers.sorted_groups(rows, ["_less", "word"])

    def run(batches):
        name, out, archive, member = None, None, None, None

        def done() -> pa.RecordBatch:
            member.close()
            archive.close()
            return pa.RecordBatch.from_pydict({"file_id": [name], "content": [out.getvalue()]}, pa.schema([("file_id", pa.string()), ("content", pa.binary())]))

        for batch in batches:
            for file_id, less, word, found in zip(*(c.to_pylist() for c in batch.columns)):
                if less is None:  # the letters, which come first
                    if out is not None:
                        yield done()
                    name, out = file_id, io.BytesIO()
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    archive.writestr("letters.txt", found)
                    member = io.TextIOWrapper(archive.open("word_counter.csv", "w"), "utf-8", newline="")
                    table = csv.writer(member)
                elif out is not None and file_id == name:
                    table.writerow((word, -less))
        if out is not None:
            yield done()

    return given.mapInArrow(run, "file_id string, content binary")


# packages


def package_bytes(manifest: dict, members: dict[str, bytes]) -> bytes:
    """A project package: the manifest and its members by their place in the package."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
        z.writestr("manifest.json", json.dumps(manifest, indent=4, ensure_ascii=False))
    return out.getvalue()


def project_manifest(title: str, src: str, trg: str, files: dict[str, dict[str, str]], task: str = "translation", due: str | None = None, notes: str | None = None, tms: list[str] = (), tbs: list[str] = (), reports: dict | None = None, resources: bool = True, only: set[str] | None = None) -> tuple[dict, dict[str, str]]:
    """(manifest, path of each member). Sources and originals go under the source language, targets under the target's."""
    manifest: dict = {"title": title, "src": src, "trg": trg, "files": {}, "task": task}
    if due:
        manifest["due_datetime"] = due
    if notes:
        manifest["notes"] = notes
    members: dict[str, str] = {}

    def placed(folder: str, path: str) -> str:
        name = str(PurePosixPath(folder, PurePosixPath(path).name))
        members[name] = path
        return name

    for key, paths in files.items():
        if only and key not in only:
            continue
        entry = {}
        if resources:
            if paths.get("source"):
                entry["source"] = placed(src, paths["source"])
            entry["originalBF"] = placed(src, paths["originalBF"])
        entry["targetBF"] = placed(trg, paths["targetBF"])
        manifest["files"][key] = entry
    for kind, folder, given in (("tms", "TM", tms), ("tbs", "TB", tbs)):
        if given and resources:
            manifest[kind] = {str(i): placed(folder, p) for i, p in enumerate(given)}
    if reports:
        manifest["reports"] = reports
    return manifest, members


def read_package(content: bytes, targets_only: bool = False) -> tuple[dict, dict[str, bytes]]:
    """(manifest, members); member names that leave the package are refused."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        manifest = json.loads(z.read("manifest.json"))
        names = [n for n in z.namelist() if n != "manifest.json"]
        if targets_only:
            names = [f["targetBF"] for f in manifest["files"].values()]
        for n in names:
            if n.startswith("/") or ".." in PurePosixPath(n).parts:
                raise ValueError(f"unsafe member {n}")
        return manifest, {n: z.read(n) for n in names}


def write_packages(members: DataFrame, manifests: DataFrame) -> DataFrame:
    """(package_id, content) from (package_id, member, content) and (package_id, manifest as JSON), one package a row."""
    listed = members.groupBy("package_id").agg(F.collect_list(F.struct("member", "content")).alias("members"))

    @F.pandas_udf("binary")
    def run(manifest: pd.Series, members: pd.Series) -> pd.Series:
        return pd.Series([package_bytes(json.loads(m), {x["member"]: bytes(x["content"]) for x in sorted(xs, key=lambda x: x["member"])} if xs is not None else {}) for m, xs in zip(manifest, members)])

    return manifests.join(listed, "package_id", "left").select("package_id", run("manifest", "members").alias("content"))


def read_packages(packages: DataFrame, targets_only: bool = False) -> DataFrame:
    """(package_id, manifest as JSON, member, content), a row for each member; unsafe packages are an error."""

    @F.pandas_udf("struct<manifest:string,members:array<struct<member:string,content:binary>>>")
    def run(content: pd.Series) -> pd.DataFrame:
        out = []
        for c in content:
            manifest, members = read_package(bytes(c), targets_only)
            out.append((json.dumps(manifest, ensure_ascii=False), [{"member": n, "content": b} for n, b in members.items()]))
        return pd.DataFrame(out, columns=["manifest", "members"])

    rows = packages.withColumn("_p", run("content")).select("package_id", F.col("_p.manifest").alias("manifest"), F.explode("_p.members").alias("m"))
    return rows.select("package_id", "manifest", "m.*")


# quality report

REPORT_COLUMNS = ("segment_id", "source", "translation", "edited", "issues")


def report_html(title: str, rows: list[dict], made: str) -> str:
    """A page with one table of ``review.issue_report`` rows."""
    cell = lambda v: html.escape("" if v is None else "; ".join(f"{i['type']} ({i['severity']}): {i['comment']}" for i in v) if isinstance(v, (list, tuple)) else str(v))
    head = "".join(f"<th>{c.replace('_', ' ')}</th>" for c in REPORT_COLUMNS)
    body = "\n".join("<tr>" + "".join(f"<td>{cell(r.get(c))}</td>" for c in REPORT_COLUMNS) + "</tr>" for r in rows)
    return f"<!DOCTYPE html>\n<html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><p>{html.escape(made)}</p><table><tr>{head}</tr>\n{body}</table></body></html>"


def report_pages(rows: DataFrame, made: str) -> DataFrame:
    """(file_id, content): a page for each file of ``review.issue_report`` rows, in the order of the segments' numbers."""

    def run(found: pd.DataFrame) -> pd.DataFrame:
        number = found.segment_id.map(lambda x: (0, int(x), x) if str(x).isdigit() else (1, 0, str(x)))
        found = found.assign(_n=number).sort_values("_n")
        name = found.file_id.iloc[0]
        listed = [{c: list(v) if c == "issues" and v is not None else v for c, v in zip(REPORT_COLUMNS, r)} for r in found[list(REPORT_COLUMNS)].itertuples(index=False)]
        return pd.DataFrame({"file_id": [name], "content": [report_html(name, listed, made)]})

    return rows.groupBy("file_id").applyInPandas(run, "file_id string, content string")
