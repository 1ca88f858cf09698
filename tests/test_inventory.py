"""Golden rows for manifests, compiler options, trees and model replies."""

from logsieve.operators import assemble as A
from logsieve.operators import inventory as G

FILES = "project_root string, path string, content string"


def files(spark, *rows):
    return spark.createDataFrame([("/r", p, c) for p, c in rows], FILES)


def test_an_odd_field_leaves_the_others(spark):
    body = '{"name":"a","engines":">=18","scripts":["odd"],"dependencies":{"x":"1"},"devDependencies":{"vitest":"1"}}'
    f = files(spark, ("package.json", body))
    assert G.manifest_facts(f).first()["name"] == "a"
    assert [r["name"] for r in G.dependencies(f).orderBy("is_dev").collect()] == ["x", "vitest"]
    assert G.test_framework(f).first()["framework"] == "vitest"


def test_what_is_not_json_is_no_manifest(spark):
    for body in ('{"name":"a"} x', "{'name':'a'}", '{"name":"a"} // c', ""):
        assert G.manifest_facts(files(spark, ("package.json", body))).first()["name"] == "unknown"


def test_options_are_true_as_values_are(spark):
    def strict(value):
        body = f'{{"compilerOptions":{{"strict":{value}}}}}'
        return G.compiler_options(files(spark, ("tsconfig.json", body))).first()["strict"]

    assert [strict(v) for v in ('"false"', "1", "{}", "true")] == [True] * 4
    assert [strict(v) for v in ("false", "0", "null", '""')] == [False] * 4


def test_tree_order(spark):
    f = files(spark, *((p, "") for p in ("src/auth/index.ts", "src/auth-client/main.ts", "src/App.ts", "src/api.ts")))
    listed = [r["path"] for r in G.file_listing(f).orderBy("sort_key").collect()]
    assert listed == ["src/auth", "src/auth/index.ts", "src/auth-client", "src/auth-client/main.ts", "src/api.ts", "src/App.ts"]
    assert [r["path"] for r in G.key_files(f).orderBy("rk").collect()][:2] == ["index.ts", "main.ts"]


def test_replies(spark):
    rows = [(0, "m", ""), (1, "m", "[1]"), (2, "m", '{"codeFix":"f","fixAlternatives":"one"}'), (3, "m", '{"codeFix":"f"} tail'), (4, "m", "null")]
    got = {r["run_id"]: r for r in A.parse_enhancements(spark.createDataFrame(rows, "run_id long, model string, text string")).collect()}
    assert [got[i]["failed"] for i in range(5)] == [True, False, False, True, True]
    assert (got[1]["narrative"], got[1]["alternatives"]) == (A.NO_NARRATIVE, [])
    assert (got[2]["code_fix"], got[2]["alternatives"]) == ("f", ["one"])
