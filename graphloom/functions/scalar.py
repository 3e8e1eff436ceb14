"""Column functions on names, paths and source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def python_module(path: Column) -> Column:
    """Dotted module of a .py path; a package's __init__ has the package's name, the root's own keeps its."""
    stem = F.regexp_replace(path, r"\.py$", "")
    return F.when(path.rlike(r"\.py$"), F.replace(F.regexp_replace(stem, r"/__init__$", ""), F.lit("/"), F.lit(".")))


def package_of(path: Column, module: Column) -> Column:
    """A package's own name for its __init__ file, else the module without its last part."""
    return F.when(path.rlike(r"(^|/)__init__\.py$"), module).when(module.contains("."), F.regexp_replace(module, r"\.[^.]*$", "")).otherwise(F.lit(""))


def join_module(parent: Column, child: Column) -> Column:
    return F.when(parent == "", child).when(F.coalesce(child, F.lit("")) == "", parent).otherwise(F.concat(parent, F.lit("."), child))


def absolute_module(raw: Column, package: Column) -> Column:
    """The module that a relative one names, seen from a package; null above the root. Absolute ones stay."""
    dots = F.length(F.regexp_extract(raw, r"^\.+", 0))
    rest = F.regexp_replace(raw, r"^\.+", "")
    parts = F.when(package == "", F.array().cast("array<string>")).otherwise(F.split(package, r"\."))
    keep = F.size(parts) - (dots - 1)
    base = F.when(keep >= 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0))), "."))
    return F.when(dots == 0, raw).otherwise(join_module(base, rest))


def normal_path(base: Column, relative: Column) -> Column:
    """base/relative with . and .. resolved; null above the root."""
    parts = F.filter(F.split(F.concat_ws("/", base, relative), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(True).alias("fine"))
    step = lambda acc, p: F.struct(
        F.when(p == "..", F.slice(acc["stack"], F.lit(1), F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))).otherwise(F.concat(acc["stack"], F.array(p))).alias("stack"),
        (acc["fine"] & ~((p == "..") & (F.size(acc["stack"]) == 0))).alias("fine"),
    )
    return F.aggregate(parts, start, step, lambda acc: F.when(acc["fine"], F.array_join(acc["stack"], "/")))


def split_alias(text: Column) -> tuple[Column, Column]:
    """Name and alias of `x as y`; alias null without one."""
    name, alias = F.split_part(text, F.lit(" as "), F.lit(1)), F.split_part(text, F.lit(" as "), F.lit(2))
    return F.trim(name), F.when(F.trim(alias) != "", F.trim(alias))


def from_import_names(text: Column) -> Column:
    """Names of a from-import list: comments and one pair of parentheses removed, split at commas, trimmed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"#[^\n]*", ""), r"^\s*\(|\)\s*$", "")
    return F.filter(F.transform(F.split(bare, ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def string_value(text: Column) -> Column:
    """What stands between the quotes of a string literal with any prefix; null if it's none."""
    hit = F.regexp_extract(text, r"(?s)^[a-zA-Z]{0,2}(\"\"\"|'''|[\"'`])(.*)\1$", 2)
    return F.when(text.rlike(r"(?s)^[a-zA-Z]{0,2}(\"\"\"|'''|[\"'`])(.*)\1$"), hit)


def location(path: Column, start_row: Column) -> Column:
    """file:line, lines from 1."""
    return F.concat(path, F.lit(":"), (start_row + 1).cast("string"))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Source between two byte offsets."""
    return F.substring(F.encode(text, "UTF-8"), start + 1, end - start).cast("string")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def directory_prefixes(path: Column) -> Column:
    """All directories above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def qualifier_root(q: Column) -> Column:
    return F.split_part(q, F.lit("."), F.lit(1))


def import_binding(kind: Column, module: Column, name: Column, alias: Column) -> Column:
    """The name an import binds: its alias, the first part of a plain module, or the imported name; none for *."""
    return F.when(alias.isNotNull(), alias).when(kind == "import", qualifier_root(name)).when(name == "*", None).otherwise(name)


def typescript_candidates(base: Column) -> Column:
    """Paths that a module path may stand for, in order."""
    ext = ["ts", "tsx", "d.ts", "js", "jsx"]
    known = base.rlike(r"\.(ts|tsx|js|jsx)$")
    more = F.array(*[F.concat(base, F.lit(f".{e}")) for e in ext])
    index = F.array(*[F.concat(base, F.lit(f"/index.{e}")) for e in ext])
    return F.concat(F.array(base), F.when(known, F.array().cast("array<string>")).otherwise(more), index)


def apply_pattern(pattern: Column, module: Column) -> Column:
    """What the * of a path pattern stands for in the module; empty for an exact match, null for none."""
    prefix, suffix = F.split_part(pattern, F.lit("*"), F.lit(1)), F.split_part(pattern, F.lit("*"), F.lit(2))
    star = pattern.contains("*")
    fits = F.startswith(module, prefix) & F.endswith(module, suffix) & (F.length(module) >= F.length(prefix) + F.length(suffix))
    inner = F.substring(module, F.length(prefix) + 1, F.length(module) - F.length(prefix) - F.length(suffix))
    return F.when(star & fits, inner).when(~star & (module == pattern), F.lit(""))


def pattern_specificity(pattern: Column) -> Column:
    return F.length(F.replace(pattern, F.lit("*"), F.lit("")))


def is_private(name: Column) -> Column:
    return name.rlike(r"^_")


def is_magic(name: Column) -> Column:
    return name.rlike(r"^__.*__$")
