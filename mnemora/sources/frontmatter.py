"""Front matter of curated documents as bounded YAML, and policies as checked JSON.

YAML needs PyYAML where the tasks run; without it every document has the error `no YAML reader`.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mnemora.functions.records import canonical, strict_load
from mnemora.operators.context import BUDGETS, LAYERS, MOST

DEPTH, NODES, ALIASES = 64, 100_000, 50


def load_yaml(text: str):
    """A mapping from YAML in which no key repeats, times stay texts, and depth, nodes and aliases are bounded."""
    import yaml

    seen = {"nodes": 0, "aliases": 0, "depth": 0}
    for event in yaml.parse(text, Loader=yaml.SafeLoader):
        opens = isinstance(event, (yaml.MappingStartEvent, yaml.SequenceStartEvent))
        seen["depth"] += opens - isinstance(event, (yaml.MappingEndEvent, yaml.SequenceEndEvent))
        seen["nodes"] += opens or isinstance(event, yaml.ScalarEvent)
        seen["aliases"] += isinstance(event, yaml.AliasEvent)
        for what, most in (("nodes", NODES), ("aliases", ALIASES), ("depth", DEPTH)):
            if seen[what] > most:
                raise ValueError(f"YAML has too many {what}" if what != "depth" else "YAML is too deep")

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers = {k: [(tag, r) for tag, r in v if tag != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

        def construct_mapping(self, node, deep=False):
            keys = [self.construct_object(k, deep=True) for k, _ in node.value if k.tag != "tag:yaml.org,2002:merge"]
            if not all(isinstance(k, str) for k in keys):
                raise ValueError("a key is no text")
            if len(set(keys)) != len(keys):
                raise ValueError("a key is repeated")
            return super().construct_mapping(node, deep)

    value = yaml.load(text, Loader=Loader)  # noqa: S506 - a safe loader
    if not isinstance(value, dict):
        raise ValueError("front matter is no mapping")
    return value


@F.pandas_udf(StructType([StructField("front_json", StringType()), StructField("front_error", StringType())]))
def front_json(text: pd.Series) -> pd.DataFrame:
    """Canonical JSON of a front matter's YAML, and what is wrong with it."""

    def one(x):
        if x is None:
            return None, None
        try:
            return canonical(load_yaml(x)).decode(), None
        except ImportError:
            return None, "no YAML reader"
        except Exception as e:  # YAML errors have many kinds; each belongs to its document
            return None, f"not bounded YAML: {e.__class__.__name__}: {e}".splitlines()[0]

    return pd.DataFrame([one(x) for x in text], columns=["front_json", "front_error"])


def with_front(documents: DataFrame) -> DataFrame:
    """documents(front_matter, error) with front, its canonical JSON; a fault of the YAML joins `error`."""
    parsed = documents.withColumn("__f", front_json("front_matter"))
    return parsed.withColumn("front", F.col("__f.front_json")).withColumn("error", F.coalesce("error", "__f.front_error")).drop("__f")


def context_policy(data: bytes) -> dict:
    """A context policy's budgets, ceiling and digest of its exact bytes; its layers may not use more than the total."""
    value = strict_load(data, 1 << 20)
    if not isinstance(value, dict) or set(value) - {"schema", *(f"{n}_chars" for n in ("budget", *LAYERS)), "default_sensitivity_ceiling"}:
        raise ValueError("a context policy has unknown fields")
    budgets = {"total": value.get("budget_chars", BUDGETS["total"]), **{n: value.get(f"{n}_chars", BUDGETS[n]) for n in LAYERS}}
    for name, n in budgets.items():
        if isinstance(n, bool) or not isinstance(n, int) or not 0 <= n <= MOST:
            raise ValueError(f"{name} must be a whole number of characters up to {MOST}")
    if sum(budgets[n] for n in LAYERS) > budgets["total"]:
        raise ValueError("the layers' budgets are more than the total")
    return {"budgets": budgets, "ceiling": value.get("default_sensitivity_ceiling", "personal"), "digest": hashlib.sha256(data).hexdigest()}


def retention_policy(data: bytes) -> dict:
    """A retention policy's grace days, held ids and digest; automatic eviction is never allowed."""
    value = strict_load(data, 1 << 20)
    days, holds = value.get("grace_days"), value.get("holds", {})
    if isinstance(days, bool) or not isinstance(days, int) or days < 0:
        raise ValueError("grace_days must be a whole number of days")
    if value.get("automatic_eviction", False) is not False:
        raise ValueError("automatic eviction is not allowed")
    lists = {k: holds.get(k, []) for k in ("evidence", "objects")}
    if any(not isinstance(x, list) or not all(isinstance(y, str) for y in x) for x in lists.values()):
        raise ValueError(f"holds must be lists of texts: {json.dumps(sorted(lists))}")
    return {"grace_days": days, "holds": lists, "digest": hashlib.sha256(data).hexdigest()}
