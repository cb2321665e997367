"""Detection over decoded views, folded texts and parsed fields, with provenance to the root text; external recognizers.

A finding in a decoded view points to the runs of the root text that it was decoded from; one in a folded text to the
characters that were folded.  Fields that stand in the text as they are have been scanned with it and are only asked about their
key; values that the syntax changed are scanned again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import enums
from ..functions.hashing import framed
from . import normalization, parsers
from .detectors import RULES, Rule, findings

#: Names of siblings that name a value.
NAME_SIBLINGS = ("name", "key")
# Entity types of an external recognizer, with the type and subtype they stand for.
ENTITIES = {
    "PERSON": ("PERSON", None),
    "EMAIL_ADDRESS": ("PERSON", "EMAIL"),
    "PHONE_NUMBER": ("PERSON", "PHONE"),
    "IP_ADDRESS": ("NETWORK_IDENTIFIER", "IP"),
    "URL": ("NETWORK_IDENTIFIER", "URL"),
    "MAC_ADDRESS": ("NETWORK_IDENTIFIER", "MAC"),
}
# Keys of engineering identifiers (letters only, lower case), their subtype, and whether a value needs a digit.
ENGINEERING = (
    (r"^(?:part(?:no|nr|num|number|id)?|(?:article|material)(?:no|nr|num|number|id)|artikel(?:nummer|nr))$", "PART_NUMBER", True),
    (r"^(?:(?:drawing|dwg)(?:no|nr|num|number|id)?|ritnings?(?:nummer|nr))$", "DRAWING_NUMBER", True),
    (r"^(?:item(?:no|nr|num|number|id)|post(?:nummer|nr))$", "ITEM_ID", True),
    (r"^(?:(?:document|doc)(?:no|nr|num|number|id)|dokument(?:nummer|nr|id))$", "DOCUMENT_ID", True),
    (r"^(?:(?:asset|equipment)(?:tag|no|nr|number|id)|utrustnings?(?:nummer|nr|id)|objekt(?:nummer|nr|id))$", "ASSET_TAG", True),
    (r"^(?:functionallocation|funcloc|floc|funktionsplats)$", "FUNCTIONAL_LOCATION", False),
    (r"^plc(?:tag|address)$", "PLC_TAG", False),
    (r"^(?:scada|historian|opc)(?:tag|point|node|nodeid)?$", "SCADA_TAG", False),
)
#: A key, and its value: quoted, or at the beginning of a line to its end (a comment or the next key ends it), or one word.
KEY_VALUE = r"""(?m)(?:^[ \t]*[-"']*([A-Za-z][\w.-]{0,63})["']?[ \t]*[:=][ \t]*|(?<![\w-])["']?([A-Za-z][\w.-]{0,63})["']?[ \t]*[:=][ \t]*)(?:"([^"\r\n]+)|'([^'\r\n]+)|([^\s"'][^\r\n]*))"""


def over_views(texts: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """(key, view, form, rule, semantic_type, subtype, start, end, value, original, spans): findings in every view, as it is and folded.

    original: ORIGINAL_EXACT in the root text, ORIGINAL_COVER folded there, ENCODED_RUNS in a decoded view; spans: of the root
    text.  A folded finding that is one of the view as it is counts once."""
    return placed(normalization.normalized(texts, key), rules, key)


def placed(views: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """As ``over_views``, of views (``normalization.normalized``) that are there already."""
    folds = normalization.folded_views(views, key)
    of = lambda df, form: df.select(F.struct(key, "view", F.lit(form).alias("form")).alias("of"), "text")
    found = findings(of(views, "RAW").union(of(folds, "FOLDED")), rules, "of").select("of.*", "rule", "semantic_type", "subtype", "start", "end", "value")
    folded = F.col("form") == "FOLDED"
    out = found.join(folds.select(key, "view", "origin", "origin_end"), [key, "view"], "left")
    out = out.withColumn("_s", F.when(folded, F.expr("origin[start]")).otherwise(F.col("start"))).withColumn("_e", F.when(folded, F.expr("origin_end[end - 1]")).otherwise(F.col("end")))
    same = Window.partitionBy(key, "view", "_s", "_e", "rule", "semantic_type", "subtype").orderBy(F.desc("form"))
    out = out.withColumn("_n", F.row_number().over(same)).where("_n = 1").join(views.select(key, "view", "parent", "origins"), [key, "view"])
    root = F.col("parent").isNull()
    kind = F.when(~root, "ENCODED_RUNS").when(folded, "ORIGINAL_COVER").otherwise("ORIGINAL_EXACT")
    spans = F.when(root, F.array(F.struct(F.col("_s").alias("start"), F.col("_e").alias("end")))).otherwise(F.col("origins"))
    return out.select(key, "view", "form", "rule", "semantic_type", "subtype", F.col("_s").alias("start"), F.col("_e").alias("end"), "value", kind.alias("original"), spans.alias("spans"))


def path_ref(scope: str | Column, path: str | Column) -> Column:
    """A digest of a field's path that is bound to its text: equal paths of one text have one, those of others do not."""
    scope = F.col(scope) if isinstance(scope, str) else scope
    return F.substring(F.sha2(framed(F.lit("field-path"), scope.cast("string"), F.to_json(path)), 256), 1, 16)


def key_hints(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """``fields(key, path, value)`` with ``hint_source`` (PATH, NAME_SIBLING, NONE) and ``hint``: the deepest segment of the path
    that names a credential, else the value of a ``name`` or ``key`` beside a ``value``, where that does."""
    deep = F.try_element_at(F.filter("path", parsers.credential_key), F.lit(-1))
    parent = F.array_join(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))), "\x00")
    last = F.try_element_at("path", F.lit(-1))
    sibling = F.max(F.when(last.isin(*NAME_SIBLINGS) & parsers.credential_key(F.col("value")), F.col("value"))).over(Window.partitionBy(key, parent))
    out = fields.withColumn("_deep", deep).withColumn("_sibling", F.when(last == "value", sibling))
    source = F.when(F.col("_deep").isNotNull(), "PATH").when(F.col("_sibling").isNotNull(), "NAME_SIBLING").otherwise("NONE")
    return out.withColumn("hint_source", source).withColumn("hint", F.coalesce("_deep", "_sibling")).drop("_deep", "_sibling")


def over_fields(texts: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """(key, path_ref, hint_source, rule, semantic_type, subtype, start, end, value) of the fields of JSON texts: the whole value
    of a field with a credential's name (context.field-key), and findings in values that do not stand in the text as they are."""
    fields = key_hints(parsers.json_fields(texts, key).where("path is not null"), key).withColumn("path_ref", path_ref(key, "path"))
    named = fields.where((F.col("hint_source") != "NONE") & (F.length("value") > 0)).select(
        key, "path_ref", "hint_source", F.lit("context.field-key").alias("rule"), F.lit("CREDENTIAL_OR_SECRET").alias("semantic_type"), F.lit(None).cast("string").alias("subtype"), F.lit(0).alias("start"), F.length("value").alias("end"), "value")
    changed = fields.join(texts.select(key, F.col("text").alias("_text")), key).where(F.expr("substring(_text, start + 1, end - start)") != F.col("value"))
    inner = findings(changed.select(F.struct(key, "path_ref", "hint_source").alias("of"), F.col("value").alias("text")), rules, "of")
    return named.union(inner.select(f"of.{key}", "of.path_ref", "of.hint_source", "rule", "semantic_type", "subtype", "start", "end", "value"))


def field_hints(fields: DataFrame, hints: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, semantic_type, subtype, start, end): whole values, without the space around them, of ``fields(key, path, value)`` whose
    path is that of ``hints(path, semantic_type, subtype)``; a segment ``*`` of a hint stands for any."""
    h = hints.select(F.col("path").alias("_hint"), "semantic_type", "subtype", F.size("path").alias("_n"))
    met = fields.withColumn("_n", F.size("path")).join(F.broadcast(h), "_n").where(F.forall(F.zip_with("_hint", "path", lambda a, b: (a == "*") | (a == b)), lambda x: x))  # as many rows as are configured
    start = F.length("value") - F.length(F.regexp_replace("value", r"^\s+", ""))
    end = F.length(F.regexp_replace("value", r"\s+$", ""))
    return met.select(key, "semantic_type", "subtype", start.alias("start"), end.alias("end")).where("end > start").distinct()


def engineering(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, subtype, value) of values whose key names an engineering identifier; parts, drawings, items, documents and assets need a digit."""
    found = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(KEY_VALUE), F.lit(g)).alias(f"g{g}") for g in range(1, 6)))
    rows = texts.select(key, F.explode(found).alias("m")).select(key, F.regexp_replace(F.lower(F.concat("m.g1", "m.g2")), "[^a-z]", "").alias("name"), F.col("m.g1").alias("leading"), F.concat("m.g3", "m.g4").alias("quoted"), F.col("m.g5").alias("bare"))
    line = F.regexp_replace(F.regexp_replace("bare", r"\s#(?:\s.*)?$|\s[A-Za-z][\w.-]{1,63}[ \t]*[:=].*$", ""), r"\s+$", "")
    word = F.regexp_extract("bare", r"""^[^\s,"'}\]]*""", 0)
    value = F.when(F.col("quoted") != "", F.col("quoted")).when(F.col("leading") != "", line).otherwise(word)
    kind, digit = F.lit(None).cast("string"), F.lit(False)
    for pattern, subtype, needs in reversed(ENGINEERING):
        kind, digit = F.when(F.col("name").rlike(pattern), subtype).otherwise(kind), F.when(F.col("name").rlike(pattern), needs).otherwise(digit)
    return rows.select(key, kind.alias("subtype"), value.alias("value"), digit.alias("_digit")).where(r"subtype is not null and value <> '' and (not _digit or value rlike r'\d')").drop("_digit")


def external(replies: DataFrame, texts: DataFrame, engine: str, capabilities: tuple[str, ...], key: str = "doc_id", most: int = 256) -> tuple[DataFrame, DataFrame]:
    """Findings and status of what an external recognizer said: ``replies(key, engine, entity, start, end, score)``, a reply
    without entities having one row with a null one.

    A reply by another engine or version is refused; an entity outside the text, without length or with a score outside 0 to 1
    fails its text; unmapped entities are counted; of equal types and spans the best score stays; a recognizer without names of
    persons is never COMPLETE, and no reply is a failure."""
    kinds = replies.sparkSession.createDataFrame([(e, t, s) for e, (t, s) in ENTITIES.items()], "entity string, semantic_type string, subtype string")
    r = texts.select(key, F.length("text").alias("_size")).join(replies, key, "left").join(F.broadcast(kinds), "entity", "left")
    bad = F.col("entity").isNotNull() & ~F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("_size")) & F.col("score").between(0, 1), F.lit(False))
    per = r.groupBy(key).agg(
        F.bool_or(F.col("engine").isNull()).alias("_none"), F.bool_or(F.col("engine") != engine).alias("_other"), F.bool_or(bad).alias("_bad"), F.count_if(F.col("entity").isNotNull()).alias("_n"),
        F.count_if(F.col("entity").isNotNull() & F.col("semantic_type").isNull()).alias("unsupported"))
    why = enums.first_failing((F.col("_none"), "NO_REPLY"), (F.col("_other"), "ENGINE_MISMATCH"), (F.col("_bad"), "INVALID_RESULT"), (F.col("_n") > most, "TOO_MANY_RESULTS"), otherwise="")
    partial = (F.col("unsupported") > 0) | F.lit("PERSON" not in capabilities)
    state = per.withColumn("reason", why).select(key, F.when(F.col("reason") != "", "FAILURE").when(partial, "PARTIAL").otherwise("COMPLETE").alias("status"), "reason", F.when(F.col("reason") == "", F.col("unsupported")).otherwise(0).alias("unsupported"))
    good = r.where("semantic_type is not null").join(state.where("status <> 'FAILURE'").select(key), key)
    found = good.groupBy(key, "semantic_type", "subtype", "start", "end").agg(F.max("score").alias("score"))
    return found, state


def place_external(found: DataFrame, views: DataFrame, key: str = "doc_id") -> DataFrame:
    """``found(key, view, start, end, ..)`` with ``original`` and ``spans`` in the root text, as findings of the views themselves have them."""
    met = found.join(views.select(key, "view", "parent", "origins"), [key, "view"])
    root = F.col("parent").isNull()
    spans = F.when(root, F.array(F.struct(F.col("start"), F.col("end")))).otherwise(F.col("origins"))
    return met.withColumn("original", F.when(root, "ORIGINAL_EXACT").otherwise("ENCODED_RUNS")).withColumn("spans", spans).drop("parent", "origins")
