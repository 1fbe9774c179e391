import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.api import Cache, Engine
from tessera.functions import layers
from tessera.functions import secrets as S
from tessera.functions import text as T
from tessera.operators import changes, monitoring, parsers, security, store
from tessera.streaming import alerts, metrics


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("HTTPServer getUserName", ["httpserver", "get", "user", "name"]), ("a_b snake_case2x", ["snake", "case2x"]), ("", []), (None, []), ("é!", []), ("x\u212ay ab\u0130cd aBCd", ["ab", "cd", "bcd"])])
def test_code_tokens(spark, text, want):
    assert one(spark, T.code_tokens(F.col("t")), t=text) == want


def test_masks(spark):
    assert one(spark, S.mask_email(F.col("t")), t="to bob.x@ex.org now") == "to [MASKED_USER]@ex.org now"
    assert one(spark, S.mask_database_url(F.col("t")), t="jdbc:mysql://u:p@h/x mongodb://a:b@c") == "jdbc:mysql://[MASKED_USER]:[MASKED_PASSWORD]@h/x mongodb://[MASKED_USER]:[MASKED_PASSWORD]@c"
    assert one(spark, S.mask_credentials(F.col("t")), t="username='bob', password=\"x\"") == "username='[MASKED_USER]', password=\"[MASKED_PASSWORD]\""


def test_detect_and_mask(spark):
    rows = spark.createDataFrame([("a", "x.py", 'api_key = "abcdefghijklmnopqrstu1"\nok\ntoken = ghp_' + "a" * 36), ("b", "y.py", "nothing"), ("c", "tests/test_z.py", 'password = "secret99"'), ("d", "z.py", None)], "chunk_id string, file_path string, content string")
    out = {r.chunk_id: r for r in security.scan(rows).collect()}
    assert out["a"].content == 'api_key = "[MASKED_API_KEY]"\nok\ntoken = "[MASKED_TOKEN]"'
    assert (out["a"].sensitivity_level, out["a"].masked_count) == ("HIGH", 2)
    assert (out["b"].content, out["b"].masked_count) == ("nothing", 0)
    assert out["c"].masked_count == 0  # a test file: the confidence is lowered
    assert out["d"].content is None
    assert security.scan(rows, whitelist=("^abc",)).where("chunk_id = 'a'").first().masked_count == 1


@pytest.mark.parametrize("path,want", [("app/models.py", "Entity"), ("a/management/commands/x.py", "Command"), ("x/test_a.py", "Test"), ("x/user_service.py", "Service"), ("x/y.py", "Unknown")])
def test_path_layers(spark, path, want):
    assert one(spark, layers.python_path_layer(F.col("p")), p=path) == want


@pytest.mark.parametrize("path,want", [("a/venv/b.py", True), ("venv/b.py", True), ("a/myvenv/b.py", False), ("a/b.pyc", True), ("a/x.egg-info/b.py", True), ("target.py", False)])
def test_ignored(spark, path, want):
    assert one(spark, layers.ignored(F.col("p")), p=path) is want


def test_framework_rules(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, layers.framework_from_imports(arr("rest_framework"))) == "django"
    assert one(spark, layers.framework_score(arr("flask", "flask_login"))) == ("flask", 1.0)
    assert one(spark, layers.python_class_layer(F.lit("A"), arr("BaseModel"), arr(), F.lit("fastapi"), F.lit("Unknown"))) == "Schema"
    assert one(spark, layers.python_function_layer(arr("app.get"), F.lit("fastapi"), F.lit("Unknown"))) == "Controller"
    got = one(spark, layers.detected_layer(F.lit("a/b.py"), F.lit("django"), F.lit("Thing"), arr("models.Model"), F.lit("f"), arr()))
    assert tuple(got) == ("Entity", "class")


def test_project_rules(spark):
    paths = spark.createDataFrame([("a/x.py",), ("b/y.py",), ("c/Z.java",), ("pom.xml",)], "path string")
    assert layers.primary_language(paths).first()[0] == "python"
    assert tuple(layers.project_type(paths).first()) == (False, True, False, False)
    assert layers.primary_language(paths.limit(0)).first()[0] == "java"
    files = spark.createDataFrame([("manage.py", ""), ("requirements.txt", "Flask==2"), ("app.py", "")], "path string, text string")
    assert layers.framework_of_project(files).first()["framework"] == "flask"


def test_python_parser():
    long_body = "\n".join(f"        x{n} = {n}" for n in range(25))
    text = f"import os\nclass A(Base):\n    def run(self, a: int, *b, **c) -> str:\n{long_body}\n        return 'x'\n"
    out = parsers.python_chunks("a.py", text)
    assert [(c[4], c[5], c[2], c[3]) for c in out] == [(None, "A", 2, 29), ("run", "A", 3, 29)]
    assert out[1][9]["arguments"] == "self:Any,a:int,*b:vararg,**c:kwarg"
    assert [c[4] for c in parsers.python_chunks("a.py", "def broken(:\n    pass\n    more here\nx = 1\n")] == ["broken"]
    pieces = parsers.python_pieces("a.py", text, 5, 60)
    assert pieces and all(c[7] <= 200 for c in pieces)


def test_java_parser():
    text = 'package p;\n\n@Service\npublic class FooService extends Bar implements A, B {\n  String s = "}{";\n  // }\n  public int go(int a) {\n    if (a > 1) { return 2; }\n    return 1;\n  }\n}\ninterface I { void x(); }\n'
    out = parsers.java_chunks("Foo.java", text)
    assert [(c[2], c[3], c[4], c[5], c[6]) for c in out] == [(3, 11, None, "FooService", "Service"), (7, 10, "go", "FooService", "Service"), (12, 12, None, "I", "Unknown")]
    assert out[0][9]["implements"] == "A,B" and out[1][9]["return_type"] == "int"


def test_html_parser():
    text = '<div th:fragment="head">\n<form action="/a">\n<input name="q" type="text">\n</form>\n</div>\n<table id="t"><tr><th>1</th><th>2</th></tr></table>\n<p th:each="x : ${y}">z</p>'
    out = parsers.html_chunks("a.html", text)
    assert [(c[4], c[2], c[3]) for c in out] == [("fragment_head", 1, 5), ("form_0", 2, 4), ("t", 6, 6), ("th_each_p", 7, 7)]
    assert out[1][9]["method"] == "GET" and out[2][9]["column_count"] == "2"


def test_changes(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "file_path string, file_hash string")
    found = changes.with_renames(changes.snapshot_diff(frame(("a", "1"), ("b", "2"), ("c", "3")), frame(("a", "1"), ("b", "9"), ("d", "3"))))
    assert {tuple(r) for r in found.collect()} == {("b", "modified", None, "9"), ("d", "renamed", "c", "3")}
    gone, todo = changes.work_sets(found)
    assert {r[0] for r in gone.collect()} == {"b", "c"} and {r[0] for r in todo.collect()} == {"b", "d"}


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), "k")
    rows = lambda *r: spark.createDataFrame(r, "k string, v int, p string")
    assert s.read() is None
    s.upsert(rows(("a", 1, None), ("b", 2, "x")))
    s.upsert(rows(("b", 3, "x"), ("c", 4, "y")))
    assert {(r.k, r.v) for r in s.read().collect()} == {("a", 1), ("b", 3), ("c", 4)}
    s.delete_where({"p": None})
    assert {r.k for r in s.read().collect()} == {"b", "c"}
    s.delete_ids(rows(("c", 0, "")))
    assert [r.k for r in s.read().collect()] == ["b"]
    s.reset()
    assert s.read().count() == 0


def test_nearest_rank(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 21)] + [("b", 5.0)], "g string, v double")
    got = {r.g: (r.p, r.q) for r in monitoring.nearest_rank(rows, ["g"], "v", {"p": 0.95, "q": 0.5}).collect()}
    assert got == {"a": (20.0, 11.0), "b": (5.0, 5.0)}


def test_alerts_batch_and_stream_agree(spark, tmp_path):
    schema = "name string, at double, value double"
    rows = spark.createDataFrame([("error_rate", float(t), v) for t, v in ((0, 0.2), (60, 0.2), (120, 0.0), (180, 0.3), (1000, 0.3), (1100, 0.0))], schema)
    want = [(0.0, "triggered"), (120.0, "resolved"), (1000.0, "triggered"), (1100.0, "resolved")]
    assert [(r.at, r.event) for r in alerts.events(alerts.evaluated(rows)).orderBy("at").collect()] == want
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = alerts.stream_events(alerts.evaluated(stream)).writeStream.format("memory").queryName("alerts").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [(r.at, r.event) for r in spark.table("alerts").orderBy("at").collect()] == want


def test_windows_stream(spark, tmp_path):
    schema = "ts timestamp, endpoint string, duration_ms double, status_code int, user_id long"
    spark.sql("SELECT timestamp_seconds(1700000000 + id * 30) ts, 'a' endpoint, 1.0D duration_ms, CAST(IF(id % 4 = 0, 500, 200) AS INT) status_code, id % 2 user_id FROM range(200)").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = metrics.request_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("windows").where("total = 10").count() > 10


def test_engine_and_git(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "app").mkdir(parents=True)
    body = "\n".join(f"    value_{n} = compute_total(user, {n})" for n in range(12))
    (repo / "app" / "models.py").write_text(f"def load_user(user):\n{body}\n    return user\n")
    (repo / "venv").mkdir()
    (repo / "venv" / "x.py").write_text("def hidden():\n    return 1\n")
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "app")
    git("commit", "-qm", "first")
    e = Engine(spark, str(tmp_path / "engine"), dims=16)
    e.process_repository(str(repo), "p")
    assert {r.file_path for r in e.chunks.read().collect()} == {"app/models.py"}
    e.process_repository(str(repo), "p")
    assert e.chunks.read().count() == 1  # ids are deterministic
    assert e.hybrid_search("load user", 3, project="p").first()["function_name"] == "load_user"
    assert e.semantic_search("load user", 3) and e.cache.stats()["misses"] == 1
    (repo / "app" / "views.py").write_text(f"def show_page(user):\n{body}\n    return 2\n")
    assert e.process_update(str(repo), "p") == {"added": 1}
    assert e.process_update(str(repo), "p") == {}
    assert e.chunks.read().count() == 2
    assert [r.subject for r in e.commits(str(repo)).collect()] == ["first"]
    with pytest.raises(ValueError):
        e.reset()
    e.delete_chunks(paths=["app/views.py"], confirm=True)
    assert e.chunks.read().count() == 1


def test_cache():
    now = [0.0]
    c = Cache(2, 10, clock=lambda: now[0])
    assert [c.get(k, lambda k=k: k) for k in "abac"] == list("abac")
    now[0] = 11
    c.get("a", lambda: 1)
    assert c.stats() == {"size": 2, "hits": 1, "misses": 4, "evictions": 1, "hit_rate": 0.2}


def test_masks_sit_where_the_secret_is(spark):
    lines = ['password = "word"', 'pass_1 = 1; password = "pass_1"', "a ghp_" + "a" * 36 + " b ghp_" + "a" * 36]
    rows = spark.createDataFrame([(str(n), "x.py", x) for n, x in enumerate(lines)], "chunk_id string, file_path string, content string")
    out = {r.chunk_id: (r.content, r.masked_count) for r in security.scan(rows).collect()}
    assert out == {"0": ('password = "[MASKED_PASSWORD]"', 1), "1": ('pass_1 = 1; password = "[MASKED_PASSWORD]"', 1), "2": ('a "[MASKED_TOKEN]" b "[MASKED_TOKEN]"', 2)}


def test_long_java_comments_take_linear_time():
    import time

    text = "class A {\n// " + "word " * 20_000 + "\n/* " + "word word\n" * 10_000 + "*/\npublic int a() { return 1; }\n}"
    began = time.time()
    assert [c[4] for c in parsers.java_chunks("A.java", text)] == [None, "a"]
    assert time.time() - began < 1


def test_straight_functions_are_cut_to_size():
    text = "def big():\n" + "".join(f"    value_{i} = compute(something, {i})\n" for i in range(900))
    parts = parsers.python_pieces("a.py", text)
    assert max(p[7] for p in parts) <= parsers.MOST and "\n".join(p[8] for p in parts) == text.rstrip("\n")


def test_keyword_index_is_built_once_for_a_version(spark, tmp_path):
    from tessera.operators import bm25
    from tessera.operators.keyword_index import KeywordIndex

    rows = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma gamma"), (3, "delta")], "doc_id long, text string")
    one = KeywordIndex(spark, str(tmp_path / "i"), "1")
    one.build(bm25.tokenized(rows))
    assert [r.id for r in one.search("gamma", 5).collect()] == [2] and one.search("", 5).count() == 0 and one.search("nothing", 5).count() == 0
    two = KeywordIndex(spark, str(tmp_path / "i"), "2")
    assert one.ready() and not two.ready()
    two.build(bm25.tokenized(rows.where("doc_id <> 2")))
    two.drop_others()
    assert not one.ready() and two.search("gamma", 5).count() == 0


def test_commits_are_processed_one_by_one(spark, tmp_path, monkeypatch):
    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-q")
    body = "def work(a):\n    first = a + 1\n    second = first * 2\n    return second  # a line of some length\n"
    for n, name in enumerate(("one.py", "two.py")):
        (repo / name).write_text(body.replace("work", f"work{n}"))
        run("add", "-A")
        run("commit", "-qm", name)
    engine = Engine(spark, str(tmp_path / "store"))
    assert [r.status for r in engine.process_commits(str(repo), "p").collect()] == ["completed", "completed"]
    assert engine.process_commits(str(repo), "p").count() == 0
    (repo / "one.py").unlink()
    (repo / "two.py").write_text("\n\n" + body)
    run("add", "-A")
    run("commit", "-qm", "third")
    real = engine._replace
    monkeypatch.setattr(engine, "_replace", lambda *a: 1 / 0)
    assert [r.status for r in engine.process_commits(str(repo), "p").collect()] == ["failed"]
    monkeypatch.setattr(engine, "_replace", real)
    assert [r.status for r in engine.process_commits(str(repo), "p").collect()] == ["completed"]
    assert [(r.file_path, r.start_line, r.function_name) for r in engine.chunks.read().collect()] == [("two.py", 3, "work")]


def test_a_missing_folder_has_no_files(spark, tmp_path):
    from tessera.sources import files

    assert files.repository(spark, str(tmp_path / "nothing"), "p").count() == 0


@pytest.mark.parametrize("pattern,want", [("a{3}", None), ("(abc)?d", None), ("(foo|bar)Bazz", "bazz"), ("x[a-z]{25}y", 27), ("ab*cde", "cde"), ("[A-Z]{10}-[A-Z]{19}", None), ("(?<n>secret)", None), (r"key\s*=\s*([^']+)", "key")])
def test_marks_of_patterns(pattern, want):
    assert security.required(pattern) == want


def test_prefilter_loses_no_match(spark):
    """Every pattern, with its mark in any case and at any place, against all patterns tried on every line."""
    import re

    samples = {"aws_access_key_id": "AKIA" + "A1" * 8, "twilio_account_sid": "ac" + "0f" * 16, "discord_token": "M" + "a" * 23 + "." + "b" * 6 + "." + "c" * 27, "python_password": "PassWord = 'abcd9'", "slack_token": "XOXB-1234567890-ab", "stripe_test_key": "sk_TEST_" + "a" * 24, "ssh_private_key": "-----BEGIN PRIVATE KEY-----", "env": "K x éİ api_KEY = \"" + "k" * 20 + "\""}
    rows = spark.createDataFrame([(f"{name}{k}", before + text + after) for name, text in samples.items() for k, (before, after) in enumerate((("", ""), ("éİ \n\n x ", "\n"), ("one\r\n", "\ntwo\n")))] + [("none", "nothing\nhere"), ("null", None)], "chunk_id string, content string")
    got = {(r.chunk_id, r.pattern_name, r.line_number, r.start_position, r.content) for r in security.detect(rows, path=None, threshold=-1.0).collect()}
    want = set()
    for r in rows.collect():
        for n, line in enumerate((r.content or "").split("\n"), 1):
            hits = [(m.start(1) if m.re.groups and m[1] else m.start(), m[1] if m.re.groups and m[1] else m[0], name, c) for _, _, name, c, p in S.patterns_for() for m in re.finditer(p, line, re.I | re.A)]
            for at, text, name, c in hits:
                beaten = any(b < at + len(text) and at < b + len(t) and (len(t), d, -b, other) > (len(text), c, -at, name) for b, t, other, d in hits)
                if not beaten:
                    want.add((r.chunk_id, name, n, at, text))
    assert got == want and len(got) >= 24


def test_a_bad_custom_pattern_is_left_out(spark):
    rows = spark.createDataFrame([("a", "code-77")], "chunk_id string, content string")
    with pytest.warns(UserWarning, match="broken"):
        found = security.detect(rows, path=None, custom=(("x", "code", "broken", 0.9, "(["), ("x", "code", "good", 0.9, r"code-(\d++)"))).collect()
    assert [(r.pattern_name, r.content, r.start_position) for r in found] == [("good", "77", 5)]
