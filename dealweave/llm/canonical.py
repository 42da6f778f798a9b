"""Mapping freely typed values to a reference list through BK-trees.

Every reference entry contributes spelled forms (its name, its words in order,
its usual short forms); they are derived where the list lies and never gathered
on the driver.  The forms are dealt into shards of bounded size; a task builds
each shard's BK-tree under the Damerau-Levenshtein metric (free transpositions,
so the triangle inequality holds and pruning loses nothing).  Finished trees are
broadcast one at a time.  Distinct typed values probe each tree for all forms
within their threshold, whole batches level by level with the distances of a
level computed together in numpy; the winners of all shards merge by distance,
and a tie between different entries leaves the value unmatched.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.llm.lexicon import ABBREVIATIONS, LEGAL_FORMS, damerau_pairs, damerau_within, encode, fold, name_tokens, strip_legal
from dealweave.session import cut_lineage, wide_parallelism

UNMATCHED = "UNMATCHED"
#: Most forms in one broadcast BK-tree (on average; forms are dealt by hash).
SHARD_FORMS = 20_000
#: Forms above this length are not in the tree: they are found by length and a banded distance.
LONG_FORM = 200
#: Typed values that descend a tree together.
PROBES = 1_000

# Usual short or alternative wordings of syndicate roles, by role code.
ROLE_WORDINGS = {
    "administrative_agent": ["aa", "admin agent", "facility agent", "facility admin agent", "administration agent", "administrator agent"],
    "bookrunner": ["books", "book runner", "bookrunning manager", "sole bookrunner", "bookmanager", "br", "physical bookrunner"],
    "co_manager": ["comanager", "cm", "co managing underwriter"],
    "collateral_agent": ["security agent", "ca", "security trustee", "collateral trustee"],
    "documentation_agent": ["co documentation agent", "documents agent", "da"],
    "financial_advisor": ["fa", "financial adviser", "m&a advisor", "m&a adviser", "m&a", "merger advisor"],
    "indenture_trustee": ["trustee", "bond trustee", "note trustee", "notes trustee", "trustee under indenture", "it"],
    "initial_purchaser": ["144a initial purchaser", "ip", "144a purchaser", "purchaser"],
    "joint_bookrunner": ["jbr", "co bookrunner", "joint bookrunning manager", "joint books", "joint book manager"],
    "joint_lead_arranger": ["jla", "co lead arranger", "joint arranger", "joint mandated lead arranger"],
    "lead_arranger": ["la", "mla", "mandated lead arranger", "sole lead arranger"],
    "lead_underwriter": ["lu", "luw", "managing underwriter", "lead managing underwriter"],
    "lender": ["bank lender", "initial lender", "lender of record", "lending bank", "senior lender"],
    "syndication_agent": ["sa", "co syndication agent", "agent for syndication"],
    "underwriter": ["uw", "several underwriter", "participating underwriter"],
}

# Abbreviations inside role names.
ROLE_ABBREVIATIONS = {
    "agt": "agent", "agnt": "agent", "ag": "agent", "admin": "administrative", "adm": "administrative", "arr": "arranger", "arrgr": "arranger", "arrg": "arranger",
    "bk": "book", "bks": "books", "coll": "collateral", "collat": "collateral", "doc": "documentation", "docs": "documentation",
    "fin": "financial", "fncl": "financial", "adv": "advisor", "ind": "indenture", "indent": "indenture", "tr": "trustee", "ttee": "trustee",
    "init": "initial", "purch": "purchaser", "jt": "joint", "jnt": "joint", "ld": "lead", "mgr": "manager", "mgrs": "manager", "mngr": "manager",
    "synd": "syndication", "undwr": "underwriter", "underwrtr": "underwriter", "uw": "underwriter", "undrwrtr": "underwriter", "rnr": "runner",
    "lndr": "lender", "lnd": "lender",
}

_TRANCHE = re.compile(r"(?:\s[-/–—]\s*|\()\s*(?:us|eur|usd|gbp|uk|euro|term|rcf|revolver)?\s*tranche\s*[a-z0-9]?\)?\s*$")
_NOTE = re.compile(r"\(\s*\d+\s*\)|[*†‡;:]+|\(\s*the\s+\W[^)]*\)")


class BKTree:
    """BK-tree in flat arrays, searched for many forms at once.

    Node k has the form ``forms[k]`` and the ids ``payloads[k]``; its children
    are listed with their distances to it.
    """

    def __init__(self, entries: list[tuple[str, str]]):
        ids: dict[str, set[str]] = defaultdict(set)
        for form, payload in entries:
            ids[form].add(payload)
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for form in ids:
            if len(form) > LONG_FORM:
                self.by_length[len(form)].append(form)
        self.forms = [f for f in ids if len(f) <= LONG_FORM]
        self.payloads = {f: sorted(p) for f, p in ids.items()}
        self.codes, self.lengths = encode(self.forms)
        self._link()

    def _link(self) -> None:
        """Let every form descend from the root, all of one level at once, until it becomes a child."""
        n = len(self.forms)
        children: list[dict[int, int]] = [{} for _ in range(n)]
        moving, at = np.arange(1, n), np.zeros(max(n - 1, 0), dtype=np.int64)
        while len(moving):
            d = damerau_pairs(self.codes[moving], self.lengths[moving], self.codes[at], self.lengths[at])
            on = []
            for k, (form, node, key) in enumerate(zip(moving.tolist(), at.tolist(), d.tolist())):
                child = children[node].setdefault(key, form)
                if child != form:
                    at[k] = child
                    on.append(k)
            moving, at = moving[on], at[on]
        self.first = np.cumsum([0, *map(len, children)])
        self.key = np.array([k for c in children for k in c], dtype=np.int64)
        self.child = np.array([v for c in children for v in c.values()], dtype=np.int64)

    def within(self, probes: list[str], limits: list[int]) -> list[list[tuple[int, str]]]:
        """For each probe all (distance, form) at most its limit away."""
        found: list[list[tuple[int, str]]] = [[] for _ in probes]
        longest = int(self.lengths.max()) if self.forms else -1
        inside = [k for k, p in enumerate(probes) if self.forms and len(p) - limits[k] <= longest]
        for start in range(0, len(inside), PROBES):
            part = inside[start : start + PROBES]
            codes, lengths = encode([probes[k] for k in part])
            limit = np.array([limits[k] for k in part])
            who, node = np.arange(len(part)), np.zeros(len(part), dtype=np.int64)
            while len(who):
                d = damerau_pairs(codes[who], lengths[who], self.codes[node], self.lengths[node])
                for k in np.flatnonzero(d <= limit[who]).tolist():
                    found[part[who[k]]].append((int(d[k]), self.forms[node[k]]))
                many = self.first[node + 1] - self.first[node]
                parent = np.repeat(np.arange(len(who)), many)
                slot = np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many) + self.first[node][parent]
                near = np.abs(self.key[slot] - d[parent]) <= limit[who][parent]
                who, node = who[parent[near]], self.child[slot[near]]
        for k, p in enumerate(probes):
            for size in range(len(p) - limits[k], len(p) + limits[k] + 1) if self.by_length else ():
                found[k] += [(d, f) for f in self.by_length.get(size, ()) if (d := damerau_within(p, f, limits[k])) <= limits[k]]
        return found


def allowance(form: str) -> int:
    """Edits granted to a form: none to initials, more to longer forms."""
    n = len(form)
    return 0 if n <= 3 else 1 if n <= 6 else 2 if n <= 11 else 3


def role_forms(value: str | None) -> list[str]:
    """Spellings of a role to look up: its words in order, then sorted, both closed up."""
    text = fold(value or "").lower().replace("_", " ").strip()
    text = _NOTE.sub(" ", _TRANCHE.sub("", _NOTE.sub(" ", text).rstrip()))
    text = re.sub(r"\bu\s*/\s*w\b", "underwriter", text)
    text = re.sub(r"\bunder\s*-\s*", "under", text)
    text = re.sub(r"\b([a-z])\s*/\s*([a-z])\b", r"\1\2", text)
    words = re.findall(r"[a-z0-9&]+", text)
    words = [ROLE_ABBREVIATIONS.get(w, w) for w in words]
    words = [w for w in words if w not in ("of", "for", "the", "under", "as", "to")]
    words = [w[:-1] if len(w) > 4 and w.endswith("s") and w not in ("books",) else w for w in words]
    plain = "".join(words)
    return list(dict.fromkeys(x for x in (plain, "".join(sorted(words))) if x))


def role_entries(code: str, label: str | None, wordings: dict[str, list[str]] = ROLE_WORDINGS) -> list[tuple[str, str]]:
    """(form, kind) of the label, the code and the usual wordings of a role."""
    return list(dict.fromkeys((form, "sure") for spelled in (label, code, *wordings.get(code, ())) for form in role_forms(spelled)))


def _expand(words: list[str]) -> list[str]:
    return [ABBREVIATIONS.get(w, w) for w in words]


def _initials(words: list[str]) -> str:
    return "".join(w[0] for w in words if w != "&")


def bank_forms(value: str | None) -> list[str]:
    """Spellings of a bank name to look up: without legal form, rotated, closed up, as typed."""
    words = name_tokens(value)
    if not words:
        return []
    core = strip_legal(words)
    full = _expand(core)
    forms = ["".join(w for w in full if w != "&")]
    if len(full) > 1:
        forms.append("".join(w for w in [full[-1], *full[:-1]] if w != "&"))
        forms.append("".join(w for w in [*full[1:], full[0]] if w != "&"))
        for cut in range(2, len(full) - 1):
            forms.append("".join(w for w in [*full[cut:], *full[:cut]] if w != "&"))
    if core != words and len(words) <= 3:
        forms.append("".join(w for w in _expand(words) if w != "&"))
    return list(dict.fromkeys(f for f in forms if f))


def bank_entries(name: str | None, short: str | None) -> list[tuple[str, str]]:
    """(form, kind) of a bank: its name is sure, its short name is short, initials and first word are loose."""
    words = name_tokens(name)
    core = strip_legal(words)
    kept = [w for w in words if w not in LEGAL_FORMS or w in ("company", "co")]
    while kept and kept[-1] == "&":
        kept.pop()
    out = [("".join(w for w in x if w != "&"), "sure") for x in (core, kept)]
    brief = set(core[:1])
    if called := "".join(strip_legal(name_tokens(short))):
        brief.add(called)
        out.append((called, "short"))
    tail = [w for w in words if w in LEGAL_FORMS and w not in ("company", "co")]
    for base in (core, kept):
        if len(base) > 1:
            initials = _initials(base)
            brief |= {initials, initials + "".join(tail), base[0] + _initials(base[1:])}
    return list(dict.fromkeys((f, kind) for f, kind in [*out, *((f, "loose") for f in sorted(brief))] if f))


def reference_forms(reference: DataFrame, key: Column, columns: list[str], spell: Callable[..., list[tuple[str, str]]]) -> DataFrame:
    """(form, id) of a reference list; entries with a null key are left out.

    A sure form belongs to all entries that have it.  A short form belongs to
    the only entry that has it as a short name, else to the only one that has it
    at all; one that several entries share never decides.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, *values in pdf.itertuples(index=False):
                rows += [(form, kind, k) for form, kind in spell(*[None if v is None or v != v else v for v in values])]
            yield pd.DataFrame(rows, columns=["form", "kind", "id"])

    typed = reference.select(key.cast("string").alias("_key"), *columns).filter("_key is not null").mapInPandas(run, "form string, kind string, id string")
    sides = [(F.min if low else F.max)(F.when(F.col("kind") == kind, F.col("id"))).alias(f"{kind}_{low}") for kind in ("short", "loose") for low in (1, 0)]
    sole = typed.groupBy("form").agg(*sides)
    owner = F.coalesce(*[F.when(F.col(f"{kind}_1") == F.col(f"{kind}_0"), F.col(f"{kind}_1")) for kind in ("short", "loose")])
    brief = sole.select("form", owner.alias("id")).filter("id is not null")
    return typed.filter("kind = 'sure'").select("form", "id").unionByName(brief).distinct()


def best_matches(tree: BKTree, values: list[str], forms: Callable[[str | None], list[str]]) -> list[list[tuple[int, str]]]:
    """(distance, id) of the closest entries of one tree over all spellings of each value, ties included."""
    spelled = [forms(v) for v in values]
    probes = list(dict.fromkeys(f for fs in spelled for f in fs))
    hits = dict(zip(probes, tree.within(probes, [allowance(p) for p in probes])))
    out = []
    for fs in spelled:
        best: dict[str, int] = {}
        for d, entry in (h for f in fs for h in hits[f]):
            if d <= allowance(entry):
                for payload in tree.payloads[entry]:
                    best[payload] = min(d, best.get(payload, d))
        low = min(best.values(), default=None)
        out.append(sorted((d, p) for p, d in best.items() if d == low))
    return out


def build_trees(entries: DataFrame, shard_forms: int = SHARD_FORMS) -> DataFrame:
    """(shard, tree): pickled BK-trees of the (form, id) rows, all ids of a form in one shard."""
    entries = cut_lineage(entries)
    shards = max(1, -(-entries.count() // shard_forms))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        # Sorted, so that a task that runs again builds the same tree.
        tree = BKTree(sorted(zip(pdf["form"], pdf["id"])))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "tree": [pickle.dumps(tree)]})

    dealt = entries.withColumn("shard", F.pmod(F.xxhash64("form"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(build, "shard int, tree binary")


def map_to_reference(values: DataFrame, value: str, entries: DataFrame, forms: Callable[[str | None], list[str]], shard_forms: int = SHARD_FORMS) -> DataFrame:
    """One row (raw_value, canonical_id) per distinct non-null value of the column.

    ``entries`` has (form, id).  A value without an entry within its allowance,
    with several equally close entries, or without any letter or digit is
    ``UNMATCHED``.  Other columns of ``values`` are not read.  An empty
    reference leaves all values unmatched.
    """
    spark = values.sparkSession
    # The few distinct values are cheap to move and dear to look up: spread them over all cores.
    distinct = values.select(F.col(value).alias("raw_value")).filter("raw_value is not null").distinct().repartition(wide_parallelism(spark), "raw_value")
    schema = "raw_value string, distance int, canonical_id string"
    hits = distinct.select("raw_value", F.lit(99).alias("distance"), F.lit(UNMATCHED).alias("canonical_id"))
    # One tree of bounded size passes through the driver at a time.
    for row in build_trees(entries, shard_forms).toLocalIterator():
        shared = spark.sparkContext.broadcast(bytes(row["tree"]))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            tree = pickle.loads(shared.value)
            for pdf in batches:
                raws = pdf["raw_value"].tolist()
                rows = [(raw, d, p) for raw, found in zip(raws, best_matches(tree, raws, forms)) for d, p in found]
                yield pd.DataFrame(rows, columns=["raw_value", "distance", "canonical_id"])

        hits = hits.unionByName(distinct.mapInPandas(run, schema))
    winners = hits.groupBy("raw_value").agg(F.min("distance").alias("low"), F.collect_set(F.struct("distance", "canonical_id")).alias("all"))
    tied = F.transform(F.filter("all", lambda x: x["distance"] == F.col("low")), lambda x: x["canonical_id"])
    return winners.select("raw_value", F.when(F.size(tied) == 1, F.get(tied, F.lit(0))).otherwise(F.lit(UNMATCHED)).alias("canonical_id"))


def map_roles(participants: DataFrame, roles: DataFrame, column: str = "role", wordings: dict[str, list[str]] = ROLE_WORDINGS) -> DataFrame:
    """Typed roles to role codes, one row per distinct value; ``wordings`` are known other wordings by role code."""
    spell = lambda code, label: role_entries(code, label, wordings)
    return map_to_reference(participants, column, reference_forms(roles, F.col("role_code"), ["role_code", "role_label"], spell), role_forms)


def map_banks(df: DataFrame, banks: DataFrame, column: str) -> DataFrame:
    """Typed bank names to bank ids as strings, one row per distinct value."""
    return map_to_reference(df, column, reference_forms(banks, F.col("id"), ["name", "short_name"], bank_entries), bank_forms)
