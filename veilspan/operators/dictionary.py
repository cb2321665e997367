"""Dictionaries of names and configured terms: longest match over words, by a join on word n-grams."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import matches

WORD = r"[\p{L}\p{N}]+"
LONGEST = 16


def terms(dictionary: DataFrame) -> DataFrame:
    """(tenant_id, term, norm, words): a term's lower-cased words with one space between; of 1 to 16 words."""
    words = F.filter(F.split(F.lower("term"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return dictionary.select("tenant_id", "term", F.array_join(words, " ").alias("norm"), F.size(words).alias("words")).where(F.col("words").between(1, LONGEST)).dropDuplicates(["tenant_id", "norm"])


def occurrences(texts: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, start, end, first, words): every place where a term's words stand in a row; other tenants' terms never match.

    ``texts(key, tenant_id, text)``.  Only lengths that the dictionary has are cut out of the texts."""
    known = terms(dictionary)
    sizes = known.select("words").distinct()
    cut = texts.select(key, "tenant_id", F.expr(matches(WORD)).alias("w"))
    each = cut.crossJoin(F.broadcast(sizes))  # at most LONGEST rows
    at = each.where(F.size("w") >= F.col("words")).select(key, "tenant_id", "w", "words", F.explode(F.expr("sequence(0, size(w) - words)")).alias("first"))
    norm = F.expr("lower(array_join(transform(slice(w, first + 1, words), x -> x.v), ' '))")
    gram = at.select(key, "tenant_id", "words", "first", norm.alias("norm"), F.expr("w[first].s").alias("start"), F.expr("w[first + words - 1].e").alias("end"))
    return gram.join(known, ["tenant_id", "norm", "words"]).select(key, "term", "start", "end", "first", "words")


def longest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Occurrences that stay when, from the left, the longest at a place wins and none overlap: a fold over one text at a time."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        free, kept = 0, []
        for i in f.sort_values(["first", "words"], ascending=[True, False]).itertuples():
            if i.first >= free:
                kept.append(i.Index)
                free = i.first + i.words
        return f.loc[kept]

    return found.groupBy(key).applyInPandas(run, found.schema)


def compiled(template: str) -> str:
    """A pattern for a template of literals and ``{A}``, ``{a}``, ``{9}``, ``{X}`` with counts (``{9:4}``, ``{A:1-3}``)."""
    import re

    kinds = {"A": "[A-Z]", "a": "[a-z]", "9": "[0-9]", "X": "[A-Za-z0-9]"}
    out, at = "", 0
    for m in re.finditer(r"\{([Aa9X])(?::(\d{1,2})(?:-(\d{1,2}))?)?\}", template):
        low, high = int(m[2] or 1), int(m[3] or m[2] or 1)
        if not 1 <= low <= high <= 64:
            raise ValueError("INVALID_TEMPLATE")
        out += re.escape(template[at : m.start()]) + f"{kinds[m[1]]}{{{low},{high}}}"
        at = m.end()
    return rf"(?<![\p{{L}}\p{{N}}]){out + re.escape(template[at:])}([\p{{L}}\p{{N}}_.-]{{0,256}})"


def templated(texts: DataFrame, templates: dict[str, str], key: str = "doc_id") -> DataFrame:
    """(key, template, start, end, whole_unit): matches of templates, extended over the identifier they begin."""
    each = [f"transform({matches(compiled(t), 1)}, m -> struct('{name}' as template, m.s as start, m.e as end, m.g1 = '' as whole_unit))" for name, t in templates.items()]
    return texts.select(key, F.explode(F.expr(f"concat({', '.join(each)})")).alias("m")).select(key, "m.*")


def units(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``found(key, start, end, ..)`` with ``unit``: a finding joins the latest group one of whose members it crosses or equals;
    nested and separate ones stay apart.  Groups grow in order of arrival, so a text is one fold."""
    import pyspark.sql.types as T

    schema = T.StructType([*found.schema.fields, T.StructField("unit", T.LongType())])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["start", "end"], ignore_index=True)
        groups: list[list[tuple[int, int]]] = []
        unit = []
        for a, b in zip(f.start, f.end, strict=True):
            for g in range(len(groups) - 1, -1, -1):
                if any((a, b) == (c, d) or a < c < b < d or c < a < d < b for c, d in groups[g]):
                    break
            else:
                g = len(groups)
                groups.append([])
            groups[g].append((a, b))
            unit.append(g)
        return f.assign(unit=unit)

    return found.groupBy(key).applyInPandas(run, schema)


