"""Extractors on our own snippets: every kind at least once, and nothing from comments."""

import pytest

from lodestar.extract.comments import code_lines
from lodestar.extract.registry import extract_text

SNIPPETS = {
    "typescript": ("src/routes/users.test.ts", "// app.get('/hidden', x)\nimport { a } from 'lib';\napp.get('/users', h)\nrouter.post(\"/users\", h)\nconst k = process.env.KEY; process.env['OTHER']\nconst q = `SELECT name FROM users WHERE id = 1`\nexport function load() { return fetch('http://a.b') }\nnew Worker('w')\nclass Box {\n  get(x) { return x }\n}\ndescribe('load', () => {})\n"),
    "python": ("tests/test_routes.py", "# @app.get('/hidden')\nimport os\nfrom a.b import c\n@app.get('/items')\ndef load():\n    x = os.getenv('KEY')\n    cur.execute('SELECT name FROM items WHERE id = 1')\n    requests.get('u')\n    asyncio.create_task(f())\nclass Box:\n    def _hid(self):\n        pass\nLIMIT = 3\ndef test_load():\n    load()\n"),
    "rust": ("src/handlers.rs", "// #[get(\"/hidden\")]\nuse a::b;\n#[get(\"/x\")]\npub fn load() {\n  env::var(\"KEY\");\n  let q = r#\"SELECT name FROM t\"#;\n  reqwest::get(u);\n  tokio::spawn(f());\n}\npub struct S { a: i32 }\nimpl S {\n    pub fn go(&self) {}\n}\nmod tests {\n    #[test]\n    fn test_load() { load(); }\n}\n"),
    "java": ("a/UserService.java", "package com.x.app;\nimport a.B;\nimport static c.D.e;\n// @GetMapping(\"/hidden\")\npublic class UserService {\n    public static final int MAX = 1;\n    @GetMapping(\"/u\")\n    public String load() { System.getenv(\"KEY\"); q(\"SELECT name FROM users u\"); return restTemplate.getForObject(\"http://a\"); }\n    @Async\n    void run() { }\n    @Test\n    public void testLoad() { load(); }\n}\ninterface I {\n}\nenum E {\n}\n"),
    "csharp": ("Controllers/U.cs", "namespace App.Api;\nusing System;\n// [HttpGet(\"/hidden\")]\npublic class U\n{\n    [HttpGet(\"/u\")]\n    public string Load() { Environment.GetEnvironmentVariable(\"KEY\"); Run(\"SELECT 1\"); return HttpClient.Get(1); }\n    public void Go() { Task.Run(() => 1); }\n    [Fact]\n    public void TestLoad() { Load(); }\n}\n"),
    "swift": ("Sources/routes.swift", "import Vapor\n// app.get(\"hidden\")\nclass S {\n    func load() { Environment.get(\"KEY\"); db(\"SELECT 1\"); URLSession.shared.go(1); Task { } }\n    func testload() { load() }\n}\nfunc routes() {\n app.get(\"hello\")\n}\n"),
    "lua": ("spec/x_spec.lua", "local m = require(\"lib\")\n-- app:get(\"/hidden\")\nfunction load()\n  os.getenv(\"KEY\")\n  q(\"SELECT 1\")\n  http.request(u)\n  ngx.timer.at(0)\nend\nfunction Obj:go()\nend\nlocal LIMIT = 1\napp:get(\"/x\", f)\nfunction test_load()\n  load()\nend\n"),
    "go": ("cmd/x/main.go", "package main\n\nimport \"os\"\n\n// http.HandleFunc(\"/hidden\", f)\n\ntype G interface{ Get() int }\ntype M struct{ a int }\n\nfunc (m *M) Get() int { return 1 }\nfunc main() {\n\thttp.HandleFunc(\"/x\", h)\n\tos.Getenv(\"KEY\")\n\tdb.Query(\"SELECT name FROM t\")\n\thttp.Get(u)\n\tgo run()\n}\nfunc TestGet(t *testing.T) {}\n"),
}
KINDS = {"imports", "registers_route", "uses_config", "touches_table", "invokes_external_api", "calls", "tests"}


@pytest.mark.parametrize("language", sorted(SNIPPETS))
def test_every_kind(language):
    path, text = SNIPPETS[language]
    got = extract_text(path, text, language)
    assert got["parse_status"] == "ok"
    assert {r["reference_kind"] for r in got["refs"]} >= KINDS
    assert {a["artifact_kind"] for a in got["artifacts"]} >= {"route", "env_var", "sql_query", "external_service", "background_job"}
    assert not any("hidden" in r["raw_target_text"] for r in got["refs"])
    assert all(s["stable_id"] == f"{language}:{s['qualified_name']}:{s['symbol_kind']}" for s in got["symbols"])


def test_go_details():
    got = extract_text(*SNIPPETS["go"], "go", "example.com/m")
    kinds = {s["qualified_name"]: s["symbol_kind"] for s in got["symbols"]}
    assert kinds == {"main.G": "interface", "main.M.a": "field", "main.M": "struct", "main.M.Get": "method", "main.main": "entrypoint", "main.TestGet": "test"}
    assert got["package"]["import_path"] == "example.com/m/cmd/x"
    assert [r["raw_target_text"] for r in got["refs"] if r["reference_kind"] == "implements"] == ["main.G"]


@pytest.mark.parametrize("bad", ["package a\nfunc f( {", "x", "package a\nfoo()", "package a\nvar x = \"abc\n", "package a\n/* x", "package a\nfunc () f() {}"])
def test_go_parse_errors(bad):
    got = extract_text("a.go", bad, "go")
    assert got["parse_status"] == "error" and got["symbols"] == [] and got["diagnostics"][0]["code"] == "PARSE_ERROR"


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("java", "a /* x\nb */ c\nd\n// e", [True, False, True, False]),
        ("java", "/* /* */\nx", [False, True]),
        ("rust", "/* /* */\nx */\ny", [False, False, True]),
        ("python", 'x = """a\nb\n"""\n# c\ny = """z"""', [True, False, False, False, True]),
        ("lua", "--[[ a\nb ]]\nx --[[ c ]]\n-- d", [False, False, True, False]),
        ("cobol", "* a", [True]),
        ("swift", "", [True]),
    ],
)
def test_comment_lines(language, text, want):
    assert code_lines(text, language) == want


def test_unknown_language_is_skipped():
    assert extract_text("a.zig", "x", "zig")["parse_status"] == "skipped"
