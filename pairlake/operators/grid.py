"""Experiment grid and the table of transformation profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# Experiments, mixing strategies and the mode word of each experiment.
EXPERIMENTS = ("Exp_all", "Exp_var", "Exp_val", "Exp_ast")
MIXES = ("M1", "M2", "M3")
MODE_WORDS = {"all": "sco", "var": "object", "val": "string", "ast": "control"}

# What every profile starts from.
DEFAULT_FLAGS = {
    "compact": "false",
    "rename": "false",
    "rename_keys": "false",
    "string_array": "false",
    "string_array_threshold": "0",
    "encoding": "none",
    "rotate": "false",
    "shuffle": "false",
    "split_strings": "false",
    "split_length": "9",
    "reserved_strings": ".*",
    "numbers": "false",
    "permute": "false",
    "permute_threshold": "0.75",
    "dead": "false",
    "dead_threshold": "0.4",
}

# What each family of transformations switches on.
NAMES = {"rename": "true"}
KEYS = {"rename_keys": "true"}
SPLITS = {"rename": "true", "split_strings": "true", "reserved_strings": ""}
BLOCKS = {"permute": "true"}
DEAD = {"dead": "true"}
MODES = {
    "string": SPLITS,
    "object": KEYS,
    "control": BLOCKS,
    "sco": {**SPLITS, **KEYS, **BLOCKS},
}
EXPERIMENT_FLAGS = {
    "Exp_var": {**NAMES, **KEYS},
    "Exp_val": {"string_array": "true", "split_strings": "true", "reserved_strings": ""},
    "Exp_ast": BLOCKS,
}
EXPERIMENT_FLAGS["Exp_all"] = {**EXPERIMENT_FLAGS["Exp_var"], **EXPERIMENT_FLAGS["Exp_val"], **BLOCKS}
# Presets do not start from the base of the experiments: no literal is reserved.
PRESET_BASE = {"compact": "true", "string_array": "true", "rotate": "true", "shuffle": "true", "rename": "true", "reserved_strings": ""}
HEAVY = {**PRESET_BASE, **BLOCKS, **DEAD, **KEYS, "numbers": "true", "split_strings": "true"}
PRESETS = {
    "low": {**PRESET_BASE, "string_array_threshold": "0.75"},
    "medium": {**HEAVY, "split_length": "10", "encoding": "base64", "string_array_threshold": "0.75"},
    "hi": {**HEAVY, "split_length": "10", "encoding": "base64", "string_array_threshold": "0.75"},
    "minify": {"compact": "true", "reserved_strings": ""},
    "A": {**PRESET_BASE, "string_array_threshold": "0.75"},
    "B": {**HEAVY, "split_length": "5", "permute_threshold": "1", "dead_threshold": "1", "string_array_threshold": "1"},
    "C": {**HEAVY, "split_length": "5", "permute_threshold": "1", "dead_threshold": "1", "string_array_threshold": "1"},
}


def grid(df: DataFrame, **axes: Sequence) -> DataFrame:
    """Each row once per cell of the axes. Built by explode: no join, no shuffle."""
    for name, values in axes.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df


def profile_rows() -> list[dict]:
    """All profiles: the twelve named cells, the bare modes, the presets."""
    rows = []

    def add(name, mode, over, partial=False, mixed=True, to_ast=False):
        rows.append(
            {"name": name, "mode": mode, "over": over, "partial": partial, "mixed": mixed, "to_ast": to_ast}
        )

    for number, mix in enumerate(MIXES, start=1):
        for short, word in MODE_WORDS.items():
            mode = f"w_{word}" if number == 1 else word if number == 2 else f"{word}_dead"
            over = {**MODES[word], **(DEAD if number == 3 else {})}
            # the whole-file modes transform the seed alone and mix nothing in
            add(f"EXP_{short}_m{number}", mode, over, partial=number == 1, mixed=number > 1)
    add("p_control", "p_control", MODES["control"], partial=True)
    add("w_control_ast", "w_control_ast", MODES["control"], partial=True, mixed=False, to_ast=True)
    for name, over in PRESETS.items():
        add(name, name, over)
    return rows


def profiles(spark: SparkSession) -> DataFrame:
    """(name, mode, partial, mixed, to_ast, flags): defaults with the overrides of each profile."""
    defaults = F.create_map(*[F.lit(x) for kv in DEFAULT_FLAGS.items() for x in kv])
    rows = [(r["name"], r["mode"], r["partial"], r["mixed"], r["to_ast"], r["over"]) for r in profile_rows()]
    raw = spark.createDataFrame(
        rows, "name string, mode string, partial boolean, mixed boolean, to_ast boolean, over map<string,string>"
    )
    merged = F.map_zip_with(defaults, F.col("over"), lambda k, base, own: F.coalesce(own, base))
    return raw.withColumn("flags", merged).drop("over")


def resolve(df: DataFrame, name: str = "profile") -> DataFrame:
    """Joins the profile to rows that name it, by profile name or by mode word."""
    table = profiles(df.sparkSession)
    by_name = table.select(F.col("name").alias("_alias"), "*")
    by_mode = table.where("name <> mode").select(F.col("mode").alias("_alias"), "*")
    aliases = by_name.unionByName(by_mode)  # fixed literal rows, a few dozen
    return df.join(F.broadcast(aliases), df[name] == F.col("_alias")).drop("_alias")
