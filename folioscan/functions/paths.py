"""Path algebra and ignore rules; rules become one regular expression each and are tested as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(path: str) -> list[str]:
    if not path.startswith("/"):
        raise ValueError(f"not an absolute path: {path}")
    return [p for p in path.split("/") if p]


def covers(parent: str, child: str) -> bool:
    """Whether ``child`` is ``parent`` or below it, by components."""
    a, b = parts(parent), parts(child)
    return a == b[: len(a)]


def below(path: str | Column, root: str | Column) -> Column:
    """The same as a column: equal, or a prefix that ends at a separator."""
    p = F.col(path) if isinstance(path, str) else path
    r = F.lit(root) if isinstance(root, str) else root
    base = F.when(r == "/", F.lit("")).otherwise(F.regexp_replace(r, "/+$", ""))
    return (p == base) | p.startswith(F.concat(base, F.lit("/")))


def ancestors(path: str | Column) -> Column:
    """The path and every folder above it but the root, shortest first."""
    c = F.col(path) if isinstance(path, str) else path
    pieces = F.filter(F.split(c, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(pieces, F.lit(1), n), "/")))


@dataclass(frozen=True)
class RootPlan:
    kind: str  # existing, subtree, merge or independent
    root: str
    merged: tuple = ()
    subtree: str | None = None


def plan_root(requested: str, existing: list[str]) -> RootPlan:
    """What registering ``requested`` means beside the ``existing`` roots."""
    for root in existing:
        if parts(root) == parts(requested):
            return RootPlan("existing", root)
    above = [r for r in existing if covers(r, requested)]
    if above:
        return RootPlan("subtree", max(above, key=lambda r: len(parts(r))), (), requested)
    inside = sorted(r for r in existing if covers(requested, r))
    return RootPlan("merge", requested, tuple(inside)) if inside else RootPlan("independent", requested)


def glob_pattern(glob: str) -> str:
    """``*`` stays within a component, ``**`` does not, ``**/`` may be empty, ``?`` is one character of a component."""
    out = ""
    for piece in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece) or re.sub(r"([\\^$.+()\[\]{}|])", r"\\\1", piece)
    return out


@dataclass(frozen=True)
class IgnoreRule:
    pattern: str
    regex: str
    folders_only: bool


def ignore_rules(text: str) -> list[IgnoreRule]:
    rules = []
    for line in re.split(r"\r?\n", text):
        shown = line.strip()
        if not shown or shown.startswith("#"):
            continue
        if shown.startswith("!"):
            raise ValueError(f"rules that include again are not supported: {shown}")
        pattern = re.sub(r"^\./", "", shown.replace("\\", "/"))
        anchored, pattern = pattern.startswith("/"), pattern.removeprefix("/")
        folders, pattern = pattern.endswith("/"), pattern.rstrip("/")
        if pattern:
            front = "^" if anchored or "/" in pattern else "(?:^|/)"
            rules.append(IgnoreRule(shown, f"(?i){front}{glob_pattern(pattern)}{'(?:$|/)' if folders else '$'}", folders))
    return rules


def ignored_by(relative: str | Column, is_folder: Column, rules: list[IgnoreRule]) -> Column:
    """The first rule that matches the path or a folder above it, else null."""
    c = F.col(relative) if isinstance(relative, str) else relative
    pieces = F.split(F.regexp_replace(c, r"\\", "/"), "/")
    last = F.size(pieces)
    prefixes = F.transform(F.sequence(F.lit(1), last), lambda n: F.struct(F.array_join(F.slice(pieces, F.lit(1), n), "/").alias("path"), (n == last).alias("leaf")))

    def hit(rule: IgnoreRule) -> Column:
        applies = lambda p: p["path"].rlike(rule.regex) & (F.lit(not rule.folders_only) | ~p["leaf"] | is_folder)
        return F.when(F.exists(prefixes, applies), F.lit(rule.pattern))

    return F.coalesce(*[hit(r) for r in rules], F.lit(None).cast("string"))


RULES = "root string, n int, pattern string, regex string, folders_only boolean"


def rule_table(spark, texts: dict[str, str]) -> DataFrame:
    """RULES: the ignore rules of several roots in order, from their texts."""
    return spark.createDataFrame([(root, n, r.pattern, r.regex, r.folders_only) for root, text in texts.items() for n, r in enumerate(ignore_rules(text))], RULES)


def ignored_by_roots(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` (root, relative, is_folder) with ``pattern``: the first rule of the own root that matches the path or a folder above it, else null.

    Rules are rows and meet the paths of their root in one join, whatever the
    number of roots. Each folder is matched once, not once for each file below
    it; files then take over what holds for the folders above them.
    """
    pieces = F.split("relative", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "/"))
    own = files.select("root", F.regexp_replace("relative", r"\\", "/").alias("relative"), "is_folder").distinct()
    inside = own.filter(F.size(pieces) > 1).select("root", "relative", F.explode(above).alias("folder"))
    first = F.min(F.struct("n", "pattern")).alias("rule")
    folders = inside.select("root", "folder").distinct().join(rules, "root").filter("folder RLIKE regex").groupBy("root", "folder").agg(first)
    leaves = own.join(rules, "root").filter("relative RLIKE regex AND (NOT folders_only OR is_folder)").groupBy("root", "relative", "is_folder").agg(first)
    below_ = inside.join(folders, ["root", "folder"]).groupBy("root", "relative").agg(F.min("rule").alias("above"))
    found = own.join(leaves, ["root", "relative", "is_folder"], "left").join(below_, ["root", "relative"], "left").select("root", F.col("relative").alias("_path"), "is_folder", F.least("rule", "above")["pattern"].alias("pattern"))
    return files.withColumn("_path", F.regexp_replace("relative", r"\\", "/")).join(found, ["root", "_path", "is_folder"], "left").drop("_path")


# Folders and files that are never sources, by name; then folders directly below the root of a volume,
# and those that are kept out by default where a whole volume is the root (* is one component).
FOLDERS = {".git": "builtin:.git", "node_modules": "builtin:node-modules", ".folioscan": "builtin:folioscan"}
TEMPORARY = ("~$", "builtin:office-temp")
AT_TOP = {"$recycle.bin": "builtin:$recycle-bin", "system volume information": "builtin:system-volume-information"}
VOLUME = {
    "windows": "volume-default:windows", "program files": "volume-default:program-files", "program files (x86)": "volume-default:program-files-x86",
    "programdata": "volume-default:program-data", "users/*/appdata": "volume-default:users-profile-appdata", "perflogs": "volume-default:perflogs",
}


def builtin_rule(relative: str | Column, is_folder: Column, volume: bool = False) -> Column:
    """The id of the built-in rule of the first component that one names, else null; ``volume``: the root is a whole volume."""
    c = F.col(relative) if isinstance(relative, str) else relative
    pieces = F.split(c, "/")
    last = F.size(pieces) - 1

    def rule(piece, i):
        folder = (i < last) | is_folder
        named = F.lit(None).cast("string")
        for name, rule_id in FOLDERS.items():
            named = F.when((F.lower(piece) == name) & folder, F.lit(rule_id)).otherwise(named)
        return F.coalesce(named, F.when((i == last) & ~is_folder & piece.startswith(TEMPORARY[0]), F.lit(TEMPORARY[1])))

    found = F.filter(F.transform(pieces, rule), lambda x: x.isNotNull())
    named = F.when(F.size(found) > 0, F.get(found, 0))
    for pattern, rule_id in (AT_TOP | (VOLUME if volume else {})).items():
        inside = F.lower(c).rlike("^" + glob_pattern(pattern) + "(/|$)") & (is_folder | (last > pattern.count("/")))
        named = F.coalesce(named, F.when(inside, F.lit(rule_id)))
    return named


def excluded_by(relative: str | Column, is_folder: Column, is_link: Column, own: Column, rules: list[IgnoreRule], volume: bool = False) -> Column:
    """The rule that keeps a path out, by precedence: own files, links, built-in rules, user rules."""
    user = ignored_by(relative, is_folder, rules)
    return F.coalesce(F.when(own, F.lit("index-artifact")), F.when(is_link, F.lit("link")), builtin_rule(relative, is_folder, volume), F.when(user.isNotNull(), F.concat(F.lit("user-rule:"), user)))
