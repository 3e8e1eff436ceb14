"""Reading repositories: file scans with ignore rules, in-memory files, the extraction pass, configuration files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from graphloom import schema
from graphloom.operators.rows import main_kind

PYTHON, TYPESCRIPT = "python", "typescript"
EXTENSIONS = {PYTHON: ("py",), TYPESCRIPT: ("ts", "tsx", "js", "jsx")}
SKIPPED = (".git", ".hg", ".svn", ".venv", "venv", "__pycache__", "node_modules", "target")
# Globs of paths that no scan of a repository gives.
IGNORED = (
    ".git/*", "*/.git/*", "node_modules/*", "*/node_modules/*", ".yarn/releases/*", ".*/tests/static/chunk-.*.js", ".*/ace/.*.js", "src/vs/platform/contextview/browser/contextMenuService.ts",
    "*/semver.js", "*/compiled/*", "*.min.js", "*@*.js",
)
#: A language needs this share of all files to be a repository's.
LANGUAGE_SHARE = 0.1


def scan(
    spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None, subdirs: tuple[str, ...] = (), ignore: str | None = None, gitignore: bool = True
) -> DataFrame:
    """(path, content) of the files below root; paths are relative to it. Contents are read only if used.

    extensions are suffixes, subdirs path prefixes, ignore a pattern on paths. Skipped directories and IGNORED paths are
    left out, and with gitignore what the repository's own ignore files say; those are few and read on the driver. Spark
    doesn't list empty files, nor those whose names begin with a dot or an underscore.
    """
    base = root.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    bare = re.sub(r"^[a-z][a-z0-9+.-]*:/*", "/", base)
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:/*", "/"), f"^{re.escape(bare)}/", "")
    found = df.select(path.alias("path"), "content")
    if gitignore:
        deepest = found.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
        found = found.where(~ignored_by(ignore_files(spark, base, deepest)))
    return filtered(found.where(~F.col("path").rlike("|".join(f"(?:{glob_match(g)})" for g in IGNORED))), extensions, subdirs, ignore)


def ignore_files(spark: SparkSession, root: str, depth: int) -> list[tuple[str, str]]:
    """(path, text) of the ignore files in folders of so many levels; found by name, since Spark's readers skip hidden files."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    start, out = fs.makeQualified(top).toString().rstrip("/"), []
    for level in range(depth):
        for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}{'/*' * level}/.gitignore")) or []:
            stream = fs.open(s.getPath())
            try:
                out.append((s.getPath().toString()[len(start) + 1 :], jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return out


def glob_match(glob: str) -> str:
    """A pattern for whole paths of a shell glob, whose star also stands for slashes."""
    parts = {"*": ".*", "?": "."}
    return "^" + "".join(parts.get(c) or re.escape(c) for c in glob) + "$"


def ignored_by(files: list[tuple[str, str]]) -> Column:
    """Whether ignore files (path, text) leave a path out: the last rule that fits it or a folder above it decides.

    Rules of a deeper file come later. A slash within a rule ties it to its file's folder, one at its end means folders
    only, a star stays within a name, two stars span folders, and an exclamation mark takes back. What lies in a folder
    that is left out stays out.
    """
    rules = []
    for path, text in sorted(files, key=lambda f: (f[0].count("/"), f[0])):
        base = re.escape(path[: -len(".gitignore")])
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            back, line = line.startswith("!"), line.removeprefix("!")
            folder, bare = line.endswith("/"), line.strip("/")
            anchored = "/" in line.rstrip("/")
            body = ""
            for part in re.split(r"(\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]*\])", bare):
                body += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^", 1) if part.startswith("[") else re.escape(part))
            rules.append((back, f"^{base}{'' if anchored else '(?:.*/)?'}{body}{'/' if folder else '(?:/|$)'}", f"^{base}{'' if anchored else '(?:.*/)?'}{body}{'/.' if folder else '$'}"))
    out = F.lit(False)
    for back, below, itself in rules:
        out = F.when(F.col("path").rlike(itself if back else below), F.lit(not back)).otherwise(out)
    return out


def filtered(files: DataFrame, extensions: tuple[str, ...] | None = None, subdirs: tuple[str, ...] = (), ignore: str | None = None) -> DataFrame:
    p = F.col("path")
    keep = ~p.rlike(rf"(^|/)({'|'.join(re.escape(s) for s in SKIPPED)})/")
    if extensions:
        keep &= p.rlike(rf"\.({'|'.join(re.escape(e.lstrip('.')) for e in extensions)})$")
    if subdirs:
        any_dir = F.lit(False)
        for s in subdirs:
            any_dir |= F.startswith(p, F.lit(s.rstrip("/") + "/"))
        keep &= any_dir
    if ignore:
        keep &= ~p.rlike(ignore)
    return files.where(keep)


def from_files(spark: SparkSession, files: dict[str, str | bytes]) -> DataFrame:
    """(path, content) of files held in memory."""
    rows = [(p, c.encode("utf-8", "surrogatepass") if isinstance(c, str) else c) for p, c in files.items()]
    return spark.createDataFrame(rows, schema.SOURCES)


def detect_language(files: DataFrame) -> str:
    """The most frequent language of the files, `other` where it has less than a tenth of them."""
    lang = F.when(F.col("path").rlike(r"\.py$"), PYTHON).when(F.col("path").rlike(r"\.(ts|tsx|js|jsx)$"), TYPESCRIPT)
    return main_kind(files.select(lang.alias("l")), "l", LANGUAGE_SHARE, "other", "language").first().language


def fnv1a(data: bytes) -> str:
    """64-bit FNV-1a in hex."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def line_count(text: str) -> int:
    return text.count("\n") + (0 if text.endswith("\n") else 1) if text else 0


def parse(files: DataFrame, language: str, hash_contents: bool = False, roots: tuple[str, ...] = ()) -> DataFrame:
    """One row per file with an array of each kind of record (schema.PARSED). Files are independent of each other.

    They are dealt out first, as sources made from a table may lie in one or two partitions; the number is given, since by
    size Spark would join small ones again, and parsing takes far longer than a shuffle of the same bytes.

    Bytes that are no UTF-8 become replacement characters, and offsets are those of the decoded text. Contents are
    hashed with SHA-256 unless hash_contents asks for the slower FNV-1a. A file with a syntax error keeps its row.
    """
    fields = StructType.fromDDL(schema.PARSED)
    types = pa.struct([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        if language == PYTHON:
            from graphloom.sources.python_parser import extract
        else:
            from graphloom.sources.typescript_parser import extract
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = raw or b""
                text = raw.decode("utf-8", "replace")
                x = extract(text) if language == PYTHON else extract(text, path)
                row = {k: getattr(x, k, None) or [] for k in schema.EXTRACTED}
                n = len(text.encode())
                last = text.rfind("\n") + 1
                row |= {
                    "path": path, "language": language, "module_name": module_of(path, roots) if language == PYTHON else None, "content_hash": fnv1a(raw) if hash_contents else sha256(raw).hexdigest(),
                    "byte_len": len(raw), "line_count": line_count(text), "has_error": x.has_error, "all_names": x.all_names,
                    "root_range": {"start_byte": 0, "end_byte": n, "start_row": 0, "start_column": 0, "end_row": text.count("\n"), "end_column": len(text[last:].encode())},
                }
                rows.append(row)
            yield pa.RecordBatch.from_struct_array(pa.array(rows, types))

    wanted = filtered(files, EXTENSIONS[language]).select("path", F.col("content").cast("binary").alias("content"))
    spark = files.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return wanted.repartition(n, "path").mapInArrow(run, schema=schema.PARSED)


def module_of(path: str, roots: tuple[str, ...] = ()) -> str | None:
    """Dotted module of a Python file, named from the first of the roots that it lies below."""
    if not path.endswith(".py"):
        return None
    for root in roots:
        if path.startswith(root.strip("/") + "/"):
            path = path[len(root.strip("/")) + 1 :]
            break
    stem = path[:-3]
    return (stem[: -len("/__init__")] if stem.endswith("/__init__") else stem).replace("/", ".")


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings are left alone."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else n
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = n if end < 0 else end + 2
        else:
            if c in "}]":
                k = len(out) - 1
                while k >= 0 and out[k].isspace():
                    k -= 1
                if k >= 0 and out[k] == ",":
                    del out[k]
            out.append(c)
            i += 1
    return "".join(out)


def tsconfig(path: str, text: str) -> dict | None:
    """dir, base_url and path mappings (most specific first) of one tsconfig; None without compilerOptions."""
    try:
        data = json.loads(strip_jsonc(text))
    except ValueError:
        return None
    options = data.get("compilerOptions") if isinstance(data, dict) else None
    if not isinstance(options, dict):
        return None
    folder = path.rsplit("/", 1)[0] if "/" in path else ""
    paths = [(p, [t for t in ts if isinstance(t, str)]) for p, ts in (options.get("paths") or {}).items() if isinstance(ts, list)]
    paths.sort(key=lambda x: (-len(x[0].replace("*", "")), "*" in x[0], x[0]))
    return {"dir": folder, "base_url": options.get("baseUrl"), "paths": paths}


def owners(files: DataFrame, codeowners: str) -> DataFrame:
    """(path, owner): the last matching line of a CODEOWNERS text decides. The rules are few; files are not."""
    rules = []
    for line in codeowners.splitlines():
        parts = line.split("#")[0].split()
        if len(parts) >= 2:
            rules.append((glob_pattern(parts[0]), parts[1:]))
    owner = F.array().cast("array<string>")
    for pattern, names in rules:
        owner = F.when(F.col("path").rlike(pattern), F.array(*map(F.lit, names))).otherwise(owner)
    return files.select("path", F.explode(owner).alias("owner"))


def glob_pattern(glob: str) -> str:
    """A path pattern of a CODEOWNERS or ignore rule as a regular expression."""
    anchored = "/" in glob.rstrip("/")
    body = re.escape(glob.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if anchored else "(?:^|.*/)") + body + ("/" if glob.endswith("/") else "(?:/.*)?$")


def changed_lines(patches: DataFrame) -> DataFrame:
    """(path, start, length): line ranges that unified diffs add, from (path, patch); removed files have none."""
    hunk = r"@@ -\d+(?:,\d+)? \+(\d+(?:,\d+)?) @@"
    h = patches.where(~F.coalesce(F.col("patch"), F.lit("")).rlike(r"(?m)^\+\+\+ /dev/null")).select("path", F.explode(F.regexp_extract_all("patch", F.lit(hunk), F.lit(1))).alias("h"))
    length = F.split_part("h", F.lit(","), F.lit(2))
    return h.select("path", F.split_part("h", F.lit(","), F.lit(1)).cast("long").alias("start"), F.when(length == "", 1).otherwise(length.try_cast("long")).alias("length")).where("length > 0")


def is_minified(text: str, longest: int = 1000, mean: int = 300) -> bool:
    """Whether script text looks machine-packed: very long lines and hardly any blanks."""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        return False
    n = sum(map(len, lines))
    return (max(map(len, lines)) > longest or n / len(lines) > mean) and sum(x.count(" ") for x in lines) < n * 0.12
