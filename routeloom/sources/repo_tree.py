"""Source trees as tables: a Python data source that keeps hidden files and prunes directories before reading them."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Directories and suffixes that decide what belongs to a scan.
CODE_IGNORED = ("node_modules", "venv", ".venv", "env", "__pycache__", ".git", ".tox", ".idea", ".vscode", "dist", "build", "target", "vendor", "tests", "test", "docs", "migrations", "coverage", "tmp", "log")
CONTRACT_IGNORED = (".git", "node_modules", "bower_components", "venv", ".venv", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", ".gradle", ".idea", "target", "build", "dist")
BUILD_IGNORED = (".git", "node_modules", "bower_components", "venv", ".venv", "__pycache__", ".tox", ".gradle", "target", "build", "dist", "vendor")
LANGUAGE = {"py": "python", "js": "nodejs", "ts": "nodejs", "tsx": "nodejs", "jsx": "nodejs", "java": "java", "rb": "ruby_on_rails", "go": "golang"}
PART_BYTES = 32 << 20


def repo_name(root: str) -> str:
    return os.path.basename(os.path.abspath(root))


@dataclass
class Files(InputPartition):
    files: list


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = [x for x in options.get("path", "").split(",") if x]
        self.ignored = set(filter(None, options.get("ignored", "").split(",")))
        self.most = int(options.get("maxBytes", 1 << 40))

    def partitions(self):
        out, now, size = [], [], 0
        for root in self.roots:
            for folder, names, files in os.walk(root):
                names[:] = sorted(n for n in names if n not in self.ignored)
                # Links to folders are not walked into; they are rows like links to files.
                for f in sorted([*files, *(n for n in names if os.path.islink(os.path.join(folder, n)))]):
                    path = os.path.join(folder, f)
                    try:
                        n = os.lstat(path).st_size
                    except OSError:
                        continue
                    now.append((root, path, n, os.path.islink(path)))
                    size += min(n, self.most)
                    if size >= PART_BYTES or len(now) >= 5000:
                        out.append(Files(now))
                        now, size = [], 0
        return [*out, Files(now)] if now or not out else out

    def read(self, part):
        for root, path, n, link in part.files:
            content = None
            try:
                if link:
                    content = os.fsencode(os.readlink(path))
                elif n <= self.most:
                    with open(path, "rb") as f:
                        content = f.read()
            except OSError:
                continue
            yield repo_name(root), os.path.relpath(path, root), content, n, link


class RepoTree(DataSource):
    """format("repo_tree"): options path (comma-separated roots), ignored (directory names), maxBytes (larger files have null content). A link's content is where it points to."""

    @classmethod
    def name(cls):
        return "repo_tree"

    def schema(self):
        return "repo string, rel_path string, content binary, size long, is_symlink boolean"

    def reader(self, schema):
        return _Reader(self.options)


def read_tree(spark: SparkSession, roots: str | list[str], ignored=(), max_bytes: int = 1 << 40) -> DataFrame:
    spark.dataSource.register(RepoTree)
    return spark.read.format("repo_tree").option("path", ",".join([roots] if isinstance(roots, str) else roots)).option("ignored", ",".join(ignored)).option("maxBytes", str(max_bytes)).load()


def code_files(tree: DataFrame, ignored=CODE_IGNORED) -> DataFrame:
    """Source files of a known language outside ignored directories, decoded, with their language; Go tests left out."""
    folders = F.slice(F.split("rel_path", "/"), 1, F.size(F.split("rel_path", "/")) - 1)
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE.items() for x in kv])
    rows = tree.where(~F.arrays_overlap(folders, F.array(*map(F.lit, ignored))) & ~F.col("is_symlink") & F.col("content").isNotNull())
    rows = rows.withColumn("language", table[F.regexp_extract("rel_path", r"\.([A-Za-z]+)$", 1)]).where("language is not null")
    return rows.where(~F.col("rel_path").rlike(r"_test\.go$")).select("repo", "rel_path", "language", F.decode("content", "UTF-8").alias("text"))


def sniff(content, pattern: str, window: int | None = None):
    """Whether a pattern occurs in the bytes (the first ``window`` of them, if given), read as Latin-1, so that offsets are bytes."""
    return F.decode(content if window is None else F.substring(content, 1, window), "ISO-8859-1").rlike(pattern)


def sniffed(files: DataFrame, pattern: str, window: int = 65536) -> DataFrame:
    """Rows whose first bytes match."""
    return files.where(sniff(F.col("content"), pattern, window))


def changed_files(spark: SparkSession, repo: str, base: str | None) -> DataFrame | None:
    """Files changed since base: committed, unstaged, staged, untracked; None where git cannot tell."""
    import subprocess

    found = set()
    # Names end in a null byte (-z): what git would quote is read as it is.
    calls = ([["diff", "--name-only", "-z", f"{base}...HEAD"]] if base else []) + [["diff", "--name-only", "-z"], ["diff", "--name-only", "-z", "--cached"], ["ls-files", "-z", "--others", "--exclude-standard"]]
    for args in calls:
        try:
            r = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, timeout=5)
        except (OSError, subprocess.TimeoutExpired):
            return None
        if r.returncode:
            return None
        found |= set(filter(None, r.stdout.split("\0")))
    return spark.createDataFrame([(x,) for x in sorted(found)], "rel_path string")


def tracked_files(spark: SparkSession, repo: str) -> DataFrame | None:
    import subprocess

    try:
        r = subprocess.run(["git", "-C", repo, "ls-files", "-z"], capture_output=True, text=True, timeout=15)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return None if r.returncode else spark.createDataFrame([(x,) for x in r.stdout.split("\0") if x], "rel_path string")
