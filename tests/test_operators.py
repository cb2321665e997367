"""Operators of the sensitive-information engine on small literal inputs."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from veilspan.functions.hashing import hmac_sha256
from veilspan.functions.spans import utf8, utf16
from veilspan.operators import classification, detectors, dictionary, evaluation, mappings, normalization, parsers, policy, regions, sentinel, wire


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize(("text", "rule", "value", "scope"), [
    ("at 192.0.2.10 now", "format.ipv4", "192.0.2.10", "DOCUMENTATION"),
    ("net 10.4.0.0/16", "format.ipv4", "10.4.0.0/16", "PRIVATE"),
    ("mail jane.doe@mail.example.com.", "format.email", "jane.doe@mail.example.com", None),
    ("aa:bb:cc:dd:ee:ff", "format.mac", "aa:bb:cc:dd:ee:ff", None),
    ("tel: 2025550133", "format.phone", "2025550133", None),
    ("see https://db01.corp:5432/x.", "format.url", "https://db01.corp:5432/x", None),
    ("see https://db01.corp:5432/x.", "format.url-host", "db01.corp", "PRIVATE"),
    ("in /srv/app/x.log.", "format.posix-path", "/srv/app/x.log", None),
    ("arn:aws:iam::123456789012:role/x", "format.aws-arn-account", "123456789012", None),
    ("host=db01", "context.name-key", "db01", "PUBLIC"),
    ("Ümß 203.0.113.9", "format.ipv4", "203.0.113.9", "DOCUMENTATION"),
])
def test_detectors_find(spark, text, rule, value, scope):
    found = detectors.findings(spark.createDataFrame([(1, text)], "doc_id long, text string")).where(F.col("rule") == rule).collect()
    assert [(r.value, r.scope) for r in found] == [(value, scope)]
    assert text[found[0].start : found[0].end] == value


def test_detectors_leave_lookalikes_alone(spark):
    texts = ["v1.2.3.4", "1.2.3.4.5", "12:30:45", "999.1.1.1", "2024-01-02", "", None, "password: ${SECRET}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = detectors.findings(df)
    assert found.count() == 0
    assert rows(detectors.status(df, found), "doc_id", "status")[6] == (6, "FAILURE")


def test_cap_reports_and_keeps(spark):
    df = spark.createDataFrame([(1, " ".join(f"10.0.0.{k % 250}" for k in range(300)))], "doc_id long, text string")
    found = detectors.capped(detectors.findings(df, tuple(r for r in detectors.RULES if r.rule == "format.ipv4")))
    assert found.count() == 300 and found.where("over").count() == 44


def test_regions_touching_stay_apart(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 9), (1, 20, 25), (1, 21, 22)], "doc_id long, start int, end int")
    bound = regions.bounds(regions.regions(df))
    assert rows(bound, "start", "end") == [(0, 8), (8, 9), (20, 25)]
    assert rows(regions.adjacent(bound), "left_region", "right_region") == [(0, 1)]
    masked = regions.masked(spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz")], "doc_id long, text string"), bound, literal="*")
    assert masked.first().text == "**jklmnopqrst*z"


def test_overlap_join_has_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0, 5000), (1, 100, 120)], "doc_id long, start int, end int")
    b = spark.createDataFrame([(1, 10, 4000), (2, 0, 9)], "doc_id long, start int, end int")
    assert regions.overlapping(a, b).count() == 2


def test_hmac_and_offsets(spark):
    got = spark.createDataFrame([("a😀bä",)], "t string").select(hmac_sha256(b"k" * 70, F.col("t")).alias("m"), utf16("t", "3").alias("u"), utf8("t", "4").alias("b")).first()
    assert got.m == hmac.new(b"k" * 70, "a😀bä".encode(), hashlib.sha256).hexdigest() and (got.u, got.b) == (4, 8)


def test_fold_maps_back(spark):
    text, origin, ends = normalization.folded("ﬁx​ é–ﬂ")
    assert text == "fix é-fl" and [origin[0], ends[1]] == [0, 1]
    df = normalization.fold(spark.createDataFrame([(1, "ﬁx")], "doc_id long, text string"))
    assert df.first().text == "fix"


def test_views_reach_or_report(spark):
    import base64

    text = "marker-value"
    for _ in range(5):
        text = base64.b64encode(text.encode()).decode()
    views, closed = normalization.views_of(f"x {text} y")
    assert len(views) == 4 and closed[0][3] == "DEPTH_LIMIT"
    got = normalization.normalized(spark.createDataFrame([(1, f"x {text} y"), (2, None)], "doc_id long, text string"))
    assert rows(got.groupBy("doc_id", "status").count(), "doc_id", "status", "count") == [(1, "PARTIAL", 4), (2, "COMPLETE", 1)]


def test_parsers(spark):
    t = lambda s: spark.createDataFrame([(1, s)], "doc_id long, text string")
    assert rows(parsers.dotenv(t("# c\nexport API_KEY='a b'\nX=1 # y")), "path", "value", "high_risk") == [("API_KEY", "a b", True), ("X", "1", False)]
    assert rows(parsers.ini(t("[a.b]\nk = v\n[c]\npassword: x")), "path", "value") == [("a.b.k", "v"), ("c.password", "x")]
    assert rows(parsers.log_fields(t('t=1 user=bob msg="a b"')), "path", "value") == [("msg", "a b"), ("t", "1"), ("user", "bob")]
    text = '{"a": [1, {"name": "api_key", "value": "s3"}], "a": true}'
    fields = parsers.json_fields(t(text)).collect()
    assert {(".".join(f.path), f.value) for f in fields} == {("a.0", "1"), ("a.1.name", "api_key"), ("a.1.value", "s3"), ("a", "true")}
    assert all(text[f.start : f.end] == f.value for f in fields) and fields[0].reasons == ["DUPLICATE_KEY"]
    assert rows(parsers.named_values(parsers.json_fields(t(text))).where("high_risk"), "value") == [("s3",)]
    assert parsers.json_fields(t('{"a":')).first().status == "FAILURE"


def test_url(spark):
    p = parsers.url_parts(spark.createDataFrame([(1, "https://u:p@h.example:99999/x"), (2, "ftp://u:p@h.example:21/x;t=1?a=b%20c&d#f"), (3, None)], "page_id long, url string"))
    assert rows(p.where("page_id = 2"), "host", "port", "params", "fragment", "high_risk") == [("h.example", "21", "t=1", "f", True)]
    assert rows(p, "page_id", "status") == [(1, "UNSUPPORTED"), (2, "COMPLETE"), (3, "UNSUPPORTED")]
    assert rows(parsers.query_pairs(p), "name", "value") == [("a", "b c"), ("d", "")]


def test_classification_order_does_not_matter(spark):
    data = [("g", "detector", f"e{k}", "FOUND", "PERSON", "EMAIL", s, True, "request", None) for k, s in enumerate(["INTERNAL", "INTERNAL", "SECRET"])]
    schema = "group_id string, channel string, id string, status string, semantic_type string, subtype string, sensitivity string, reversible boolean, scope string, confidence double"
    got = {tuple(classification.composed(spark.createDataFrame(d, schema)).first()) for d in (data, data[::-1])}
    assert len(got) == 1 and got.pop()[-1] == "CONFLICTING_SENSITIVITY"
    assert classification.composed(spark.createDataFrame(data[:2], schema)).first().status == "RESOLVED"


def test_policy_fails_closed(spark):
    profiles = spark.createDataFrame([("p", "EXTERNAL", ["KEEP", "MASK"], "INTERNAL")], "profile_id string, exposure string, permitted array<string>, max_cleartext string")
    rules = spark.createDataFrame([("r", "p", "PERSON", ["INTERNAL", "RESTRICTED"], ["TRUSTED"], ["SEND"], "KEEP", ["MASK"])], "rule_id string, profile_id string, semantic_type string, sensitivities array<string>, source_trusts array<string>, operations array<string>, decision string, review_treatments array<string>")
    asks = [(1, "p", "INTERNAL"), (2, "p", "RESTRICTED"), (3, "q", "INTERNAL"), (4, "p", "PUBLIC")]
    requests = spark.createDataFrame([(i, p, "EXTERNAL", "SEND", "TRUSTED", "RESOLVED", "PERSON", s) for i, p, s in asks], "request_id int, profile_id string, trust_zone string, operation string, source_trust string, status string, semantic_type string, sensitivity string")
    assert rows(policy.decided(requests, profiles, rules), "request_id", "reason") == [(1, "RULE_SELECTED"), (2, "UNSAFE_TREATMENT"), (3, "PROFILE_MISMATCH"), (4, "NO_RULE")]


def test_bag_matching_uses_each_event_once(spark):
    schema = "case_id int, field_ref string, start int, end int, semantic_type string, subtype string"
    planted = spark.createDataFrame([(1, "f", 0, 3, "PERSON", None)] * 2, schema)
    events = spark.createDataFrame([(1, "f", 0, 3, "PERSON", None)] * 3, schema)
    assert rows(evaluation.report(planted, events), "matched", "missed", "false_positives") == [(2, 0, 1)]


def test_unmatched_events_with_one_id_are_judged_apart(spark):
    schema = "event_id int, case_id int, field_ref string, start int, end int, semantic_type string, subtype string"
    events = spark.createDataFrame([(1, 1, "f", 0, 8, "PERSON", None), (1, 1, "f", 20, 28, "PERSON", None), (2, 1, "f", 5, 13, "PERSON", None), (3, 1, "f", 4, 5, "HOST", None), (4, None, "f", 4, 5, "PERSON", None)], schema)
    planted = spark.createDataFrame([], "case_id int, field_ref string, start int, end int, semantic_type string, subtype string")
    negatives = spark.createDataFrame([(1, "f", 2, 5, ["PERSON"]), (1, "f", 28, 30, ["PERSON"]), (None, "f", 4, 5, ["PERSON"])], "case_id int, field_ref string, start int, end int, not_a array<string>")
    assert rows(evaluation.unmatched(events, planted, negatives), "event_id", "kind") == [(1, "NEGATIVE_CONTRADICTED"), (1, "UNRESOLVED"), (2, "UNRESOLVED"), (3, "UNRESOLVED"), (4, "UNRESOLVED")]


def test_sealing_and_chain(spark):
    key = b"0" * 32
    df = mappings.sealed(spark.createDataFrame([("t", "m", "v")], "tenant_id string, mapping_ref string, value string"), key)
    assert mappings.opened(df.drop("value"), key).first().value == "v"
    assert mappings.opened(df.drop("value").withColumn("tenant_id", F.lit("u")), key).first().value is None
    events = spark.createDataFrame([(1, "k", "OK", t, t) for t in range(5)], "stream long, kind string, outcome string, occurred_at long, event_id long")
    entries = mappings.chained(events, b"k")
    assert mappings.verified(entries, mappings.checkpoints(entries), b"k").first().finding == "VERIFIED_TO_ANCHOR"
    assert mappings.verified(entries.where("sequence <> 3"), entries.limit(0).select("stream", "sequence", "entry_digest"), b"k").first().finding == "CHAIN_BROKEN"


def test_dictionary_is_scoped_and_longest(spark):
    terms = spark.createDataFrame([("t", "Acme"), ("t", "acme north"), ("u", "north star")], "tenant_id string, term string")
    texts = spark.createDataFrame([(1, "t", "The ACME North star, acme")], "doc_id long, tenant_id string, text string")
    assert rows(dictionary.longest(dictionary.occurrences(texts, terms)), "term", "start", "end") == [("Acme", 21, 25), ("acme north", 4, 14)]
    got = dictionary.templated(texts.withColumn("text", F.lit("PN-1234 and PN-12345x")), {"part": "PN-{9:4}"})
    assert rows(got, "start", "end", "whole_unit") == [(0, 7, True), (12, 21, False)]


def test_sentinel(spark):
    import base64

    known = spark.createDataFrame([("t", "ORIGINAL", "Project Bluebird", "r1"), ("t", "CANARY", "zx9k", "c1"), ("u", "ORIGINAL", "harmless words", "r2")], "tenant_id string, kind string, value string, ref string")
    said = ["the project-bluebird plan", base64.b64encode(b"about Project Bluebird.").decode(), "has zx9k inside", "harmless words", None]
    messages = spark.createDataFrame([(k, "t", s, "d", "d" if k != 3 else "e") for k, s in enumerate(said)], "message_id int, tenant_id string, text string, destination string, authorized_destination string")
    assert rows(sentinel.checked(messages, known, b"k"), "message_id", "decision", "reasons") == [
        (0, "BLOCK", "KNOWN_VALUE_FOUND"), (1, "BLOCK", "KNOWN_VALUE_FOUND"), (2, "BLOCK", "CANARY_FOUND"), (3, "BLOCK", "DESTINATION_MISMATCH"), (4, "BLOCK", "INVALID_INPUT")]


def test_sentinel_asks_every_pattern(spark):
    import base64

    risky = ["Authorization: Bearer abcdefgh1234", "'authorization' = \"basic QWxhZGRpbjpvcGVu\"", "password=hunter22", "api_key: 'some words'", "see https://u:pw4you@h.example/x", "redis://:secret1@cache",
             base64.b64encode(b"password=hunter22 and more").decode(), "it's \"so\": PASSWORD: \"its4\" token=x", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18]
    fine = ["password: ${SECRET}", "password = config.password", "password: password", "PWD=/srv/app", "token: <your token>", "https://u:${pw}@h/x", "https://h.example:8080/x@y", "it's a \"plain\" text", "secret: null", "api_key='{{ key }}'", "level = x ? 'SECRET' : 'INTERNAL'", "password = a" + ".b" * 20_000]
    known = spark.createDataFrame([("t", "ORIGINAL", "Project Bluebird", "r1")], "tenant_id string, kind string, value string, ref string")
    messages = spark.createDataFrame([(k, "t", s, "d", "d") for k, s in enumerate(risky + fine)], "message_id int, tenant_id string, text string, destination string, authorized_destination string")
    assert rows(sentinel.checked(messages, known, b"k"), "message_id", "decision", "reasons") == [(k, *(("BLOCK", "HIGH_RISK_PATTERN") if k < len(risky) else ("ALLOW", ""))) for k in range(len(risky + fine))]


def test_wire(spark):
    bodies = ['{"model":"m","messages":[{"role":"user","content":"hi"}]}', "{", '{"model":"m","messages":[]}', '{"model":"m","messages":[{"role":"tool","content":"x"}]}']
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id int, body string")
    assert rows(wire.requests(df).na.fill({"refusal": ""}), "request_id", "refusal") == [(0, ""), (1, "INVALID_JSON"), (2, "NO_MESSAGES"), (3, "UNSUPPORTED_ROLE")]
    assert rows(wire.messages(df), "role", "text") == [("user", "hi")]


def test_units_follow_arrival(spark):
    found = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 4, 5), (1, 20, 22)], "doc_id long, start int, end int")
    assert rows(dictionary.units(found), "start", "unit") == [(0, 0), (3, 0), (4, 1), (20, 2)]
