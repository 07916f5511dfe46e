"""Shell commands: normal form and class, by an ordered table of rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules in order of precedence: id, class, pattern, why.  Ids, classes and patterns are fixed values.
RULES = [
    ("GIT_PUSH_FORCE_WITH_LEASE", "allow", r"(?i)^git\s+push\s+(?:.*\s+)?--force-with-lease\b", "the lease makes it safe"),
    ("RM_RF_ROOT", "block", r"^rm\s+(?:-[a-zA-Z]*[rR][a-zA-Z]*[fF][a-zA-Z]*|-[a-zA-Z]*[fF][a-zA-Z]*[rR][a-zA-Z]*)\s+/+\s*$", "deletes the whole file system"),
    ("RM_RF_STAR_ROOT", "block", r"^rm\s+(?:-[a-zA-Z]*[rR][a-zA-Z]*[fF][a-zA-Z]*|-[a-zA-Z]*[fF][a-zA-Z]*[rR][a-zA-Z]*)\s+/\*", "deletes the whole file system"),
    ("RM_RF_HOME", "block", r"^rm\s+(?:-[a-zA-Z]*[rR][a-zA-Z]*[fF][a-zA-Z]*|-[a-zA-Z]*[fF][a-zA-Z]*[rR][a-zA-Z]*)\s+(?:\$HOME|~)/?\s*$", "deletes the home directory"),
    ("GIT_PUSH_FORCE_PROTECTED", "block", r"(?i)^git\s+push\s+(?:.*\s+)?(?:--force|-f)\b.*\b(?:main|master|prod|production|release/\S+)\b", "rewrites a shared branch"),
    ("GIT_RESET_HARD_PROTECTED", "block", r"(?i)^git\s+reset\s+--hard\s+(?:origin/)?(?:main|master|release/\S+|prod|production)\b", "throws local work away for a shared branch"),
    ("DROP_DATABASE", "block", r"(?i)\bdrop\s+database\b", "can't be undone"),
    ("DD_OF_DEV", "block", r"^(?:sudo\s+)?dd\b.*\bof=/dev/(?:sd|nvme|hd|vd|mmcblk|xvd)", "writes over a disk"),
    ("MKFS_ANY", "block", r"^(?:sudo\s+)?mkfs(?:\.[a-zA-Z0-9]+)?\s+/dev/", "formats a disk"),
    ("KUBECTL_DELETE_PROD", "block", r"^kubectl\s+delete\b.*(?:--namespace(?:=|\s+)prod(?:uction)?\b|-n\s+prod(?:uction)?\b|--context(?:=|\s+)\S*prod\S*)", "changes production by hand"),
    ("RM_RF_DOT_GIT", "warn", r"^rm\s+(?:-[a-zA-Z]*[rR][a-zA-Z]*[fF][a-zA-Z]*|-[a-zA-Z]*[fF][a-zA-Z]*[rR][a-zA-Z]*)\s+\.git\b", "deletes a repository's history"),
    ("GIT_PUSH_FORCE_GENERIC", "warn", r"(?i)^git\s+push\s+(?:.*\s+)?(?:--force|-f)\b", "rewrites a remote branch"),
    ("GIT_RESET_HARD_GENERIC", "warn", r"(?i)^git\s+reset\s+--hard\b", "throws local work away"),
    ("GIT_CLEAN_FDX", "warn", r"(?i)^git\s+clean\s+-[a-zA-Z]*[fdx][a-zA-Z]*", "deletes files that git doesn't know"),
    ("GIT_BRANCH_FORCE_DELETE", "warn", r"(?i)^git\s+branch\s+-D\b", "may lose commits"),
    ("KUBECTL_DELETE_GENERIC", "warn", r"^kubectl\s+delete\b", "changes a cluster"),
    ("CHMOD_777_RECURSIVE", "warn", r"^chmod\s+-R\s+0?7{3}\b", "opens files to everybody"),
    ("CURL_PIPE_BASH", "warn", r"^(?:curl|wget)\b[^|]*\|\s*(?:sudo\s+)?(?:bash|sh|zsh)\b", "runs what it downloads"),
    ("RM_RF_RECURSIVE_GENERIC", "warn", r"^rm\s+(?:-[a-zA-Z]*[rR][a-zA-Z]*[fF][a-zA-Z]*|-[a-zA-Z]*[fF][a-zA-Z]*[rR][a-zA-Z]*)\s+\S", "deletes a tree"),
]
#: Normalisation steps in order: pattern and replacement; fixed values.
STEPS = [
    (r"^[\t\n\r ]+|[\t\n\r ]+$", ""),
    (r"[ \t]+", " "),
    (r"^env (?:[A-Za-z_][A-Za-z0-9_]*=[^ ]* )*", ""),
    (r"^(?:(?:time|nice|ionice|nohup|exec) +)+", ""),
]
CLASSES = ("allow", "warn", "block", "unknown")


def normalise(command: Column) -> Column:
    for pattern, to in STEPS:
        command = F.regexp_replace(command, pattern, to)
    return command


def verdict(command: Column) -> Column:
    """``struct<class, rule_id, reason>`` of the first rule that matches the normal form."""
    norm, out = normalise(command), None
    for rule, kind, pattern, why in RULES:
        got = F.struct(F.lit(kind).alias("class"), F.lit(rule).alias("rule_id"), F.lit(why).alias("reason"))
        out = F.when(norm.rlike(pattern), got) if out is None else out.when(norm.rlike(pattern), got)
    return out.otherwise(F.struct(F.lit("unknown").alias("class"), F.lit("").alias("rule_id"), F.lit("").alias("reason")))


def mode(text: Column) -> Column:
    """``shadow``, ``warn`` or ``block``; anything else is ``shadow``."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("warn", "block"), low).otherwise("shadow")


def exit_code(kind: Column, mode_: Column) -> Column:
    """2 only where a blocked command meets mode ``block``."""
    return F.when((kind == "block") & (mode_ == "block"), 2).otherwise(0)


def upgrade(df, column: str = "cmd", model=None):
    """``verdict`` of each command, where unknown ones may be judged by ``model``.

    ``model`` maps a pandas Series of normal forms to classes (a remote
    classifier, say); its failures and strange answers stay ``unknown``.
    """
    out = df.withColumn("verdict", verdict(F.col(column)))
    if model is None:
        return out
    @F.pandas_udf("string")
    def ask(s: pd.Series) -> pd.Series:
        try:
            got = pd.Series(model(s)).where(lambda x: x.isin(CLASSES), "unknown")
        except Exception:  # a judge that fails must not stop the batch
            got = pd.Series(["unknown"] * len(s))
        return got

    unknown = F.col("verdict.class") == "unknown"
    asked = F.when(unknown, ask(normalise(F.col(column)))).otherwise(F.col("verdict.class"))
    rule = F.when(unknown & (asked != "unknown"), "model").otherwise(F.col("verdict.rule_id"))
    return out.withColumn("verdict", F.struct(asked.alias("class"), rule.alias("rule_id"), F.col("verdict.reason").alias("reason")))
