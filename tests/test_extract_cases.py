"""Exact records of small sources, read one by one: (language, path, text, records).

A symbol is "kind qualified-name visibility first-last", a reference "kind target :line", an artifact "kind = name".
"""

import pytest

from lodestar.extract.registry import extract_text

CASES = [
    ("python", 'a/m.py', 'class A:\n    x = 1\n\n    def f(self):\n        if x:\n            pass\n\n    async def _g(self):\n        pass\n\ndef h(): pass\n', """
function a.m.h ex 11-12
class a.m.A ex 1-10
method a.m.A.f ex 4-7
method a.m.A._g un 8-10
calls f :4
calls _g :8
calls h :11
"""),
    ("python", 'a/m.py', 'async def f():\n    return g()\n\n# def no():\n', """
function a.m.f ex 1-5
calls f :1
calls g :2
"""),
    ("python", 'a/__init__.py', 'from . import b\nMAX_2 = 1\n_x = 2\n', """
const a.__init__.MAX_2 ex 2-2
imports . :1
"""),
    ("python", 'm.py', "@task(retries=2)\n@app.route('/r')\ndef f():\n    pass\n", """
function m.f ex 3-5
decorator m.@task ex 1-1
decorator m.@app.route ex 2-2
registers_route /r :2
calls task :1
calls f :3
calls app.route :2
route = ANY /r
"""),
    ("python", 't/test_m.py', 'def test_load():\n    load()\n\ndef load():\n    pass\n', """
test t.test_m.test_load ex 1-3
function t.test_m.load ex 4-6
calls test_load :1
calls load :2
calls load :4
tests load :1
"""),
    ("python", 'm.py', 'def f():\n    """doc\n    requests.get(x)\n    """\n    q = """DELETE FROM t WHERE a = 1"""\n', """
function m.f ex 1-6
touches_table DELETE FROM t WHERE a = 1 :5
calls f :1
sql_query = DELETE FROM t WHERE a = 1
"""),
    ("python", 'db/migrations/1.py', "x = settings.DEBUG\nos.environ['A']\nos.environ.get('B')\n", """
uses_config A :2
uses_config B :3
uses_config DEBUG :1
migrates db/migrations/1.py :1
calls environ.get :3
env_var = A
env_var = B
config_key = DEBUG
migration = db/migrations/1.py
"""),
    ("python", 'm.py', 'threading.Thread(target=f)\nsubprocess.run(c)\n@shared_task\ndef j():\n\tpass\n', """
function m.j ex 4-6
decorator m.@shared_task ex 3-3
calls j :4
calls threading.Thread :1
calls subprocess.run :2
background_job = app.task
background_job = Thread
background_job = subprocess
"""),
    ('typescript', 'a.ts', 'import * as fs from \'fs\'\nimport x, { y } from "lib"\nexport interface I { a: string }\nexport type T = string\ntype U<V> = V\n', """
interface a.I ex 3-3
type a.T ex 4-4
type a.U un 5-5
imports fs :1
imports lib :2
"""),
    ('typescript', 'a.ts', 'export const f = async (a: number) => {\n  return a\n}\nlet n = 1\nexport abstract class C {\n  static async m() {\n  }\n  constructor() {}\n}\n', """
function a.f ex 1-3
class a.C ex 5-9
const a.f ex 1-3
var a.n un 4-9
method a.C.m ex 0-0
calls async :1
calls m :6
calls constructor :8
"""),
    ('typescript', 'api/route.ts', "export async function GET(req) {\n}\n@Get('/x')\nlist() {}\n", """
function api/route.GET ex 1-2
registers_route /x :3
registers_route  :1
calls list :4
route = GET /x
route = GET 
"""),
    ('typescript', 'a.test.ts', "describe('load it', () => {\n  it('works', () => {})\n})\nfunction load_it() {}\n", """
function a.test.load_it un 4-4
test a.test.load_it un 1-0
test a.test.works un 2-0
calls describe :1
calls it :2
calls load_it :4
"""),
    ('typescript', 'a.js', "/* fetch('http://no') */\nfetch('http://yes')\naxios.post(`http://a`)\nnew Queue('q')\n", """
invokes_external_api http://yes :2
invokes_external_api http://a :3
calls fetch :2
calls axios.post :3
external_service = fetch
external_service = axios.post
background_job = Queue
"""),
    ('typescript', 'migrations/1.ts', "db.query('ALTER TABLE users ADD COLUMN x INT')\n", """
migrates migrations/1.ts :0
touches_table ALTER TABLE users ADD COLUMN x INT :1
calls db.query :1
migration = migrations/1.ts
sql_query = ALTER TABLE
"""),
    ('rust', 'src/lib.rs', 'pub(crate) fn a() {}\nasync fn b() {\n}\npub enum E { A }\npub trait T {\n}\npub type X = u8;\nstatic S: u8 = 1;\nmacro_rules! m {\n}\n', """
function src::a ex 1-1
function src::b un 2-3
enum src::E ex 4-4
trait src::T ex 5-6
type src::X ex 7-7
const src::S un 8-8
macro src::m ex 9-10
calls a :1
calls b :2
"""),
    ('rust', 'src/a/mod.rs', 'impl<T> Show for Thing {\n    pub fn show(&self) {\n    }\n    fn hide() {}\n}\n', """
method src::a::Thing::show ex 2-3
method src::a::Thing::hide un 4-4
calls show :2
calls hide :4
"""),
    ('rust', 'src/a.rs', '#[test]\n#[ignore]\nfn test_x() {}\n\n#[test]\nfn x() {}\n', """
test src::a::test_x un 3-3
test src::a::x un 6-6
calls test_x :3
calls x :6
"""),
    ('rust', 'src/a.rs', '/* env::var("A") /* b */ */\nfn f() { dotenv::var("B"); a::b::c(1); x.y(); log!(1); println!("x") }\n', """
function src::a::f un 2-2
uses_config B :2
calls f :2
calls dotenv::var :2
calls a::b::c :2
calls x.y :2
calls log! :2
env_var = B
"""),
    ('rust', 'src/a.rs', 'fn f() {\n  let q = sqlx::query!("UPDATE t SET a = 1");\n  std::thread::spawn(g);\n}\nRouter::new().route("/r", get(h));\n', """
function src::a::f un 1-4
registers_route /r :5
touches_table UPDATE t SET a = 1 :2
calls f :1
calls get :5
calls std::thread::spawn :3
calls Router::new :5
calls query! :2
route = GET /r
sql_query = UPDATE t SET a = 1
background_job = thread::spawn
"""),
    ('java', 'A.java', 'package a.b;\nclass A {\n  private static final int K = 1;\n  List<String> f(int x) {\n    return g(x);\n  }\n}\ninterface I {\n  void m();\n}\n@interface N {\n}\n', """
class a.b.A un 2-7
interface a.b.I un 8-10
annotation a.b.N un 11-12
const a.b.A.K un 3-3
method a.b.A.f un 4-6
method a.b.A.g un 5-5
method a.b.I.m un 9-9
calls f :4
calls g :5
calls m :9
"""),
    ('java', 'T.java', 'class T extends TestCase {\n    public void testA() {\n    }\n    void other() {\n    }\n}\n', """
class T.T un 1-6
test T.T.testA ex 2-3
method T.T.other un 4-5
calls testA :2
calls other :4
"""),
    ('java', 'R.java', '@Path("/base")\nclass R {\n    @GET\n    public String get() { return ""; }\n}\n', """
class R.R un 2-5
method R.R.get ex 4-4
registers_route /base :3
calls get :4
route = GET /base
"""),
    ('java', 'A.java', 'class A {\n    @ParameterizedTest\n    @ValueSource\n    void many(int x) {}\n    @Value("${app.key}")\n    String k;\n    // @GetMapping("/no")\n}\n', """
class A.A un 1-8
test A.A.many un 4-4
uses_config app.key :5
calls many :4
config_key = app.key
"""),
    ('java', 'flyway/V1.java', 'class V { String q = "INSERT INTO t (a) VALUES (1)"; }\n', """
class flyway.V1.V un 1-1
migrates flyway/V1.java :0
touches_table INSERT INTO t (a) VALUES (1) :1
calls t :1
migration = flyway/V1.java
sql_query = INSERT
"""),
    ('csharp', 'A.cs', 'namespace N.M;\nusing static System.Math;\npublic sealed class A\n{\n    public const int K = 1;\n    public override async Task<int> Run()\n    {\n        await Go();\n    }\n}\npublic struct S { }\npublic enum E { X }\n', """
class N.M.A ex 3-10
enum N.M.E ex 12-12
struct N.M.S ex 11-11
const N.M.A.K ex 5-5
method N.M.A.Run ex 6-9
method N.M.A.Go un 8-8
imports System.Math :2
"""),
    ('csharp', 'T.cs', 'public class T\n{\n    [Theory]\n\n    [InlineData(1)]\n    public void Works(int x) { }\n    [Obsolete]\n    public void Old() { }\n}\n', """
class T.T ex 1-9
test T.T.Works ex 6-6
method T.T.Old ex 8-8
"""),
    ('csharp', 'P.cs', 'app.MapGet("/x", h);\nvar a = config["A:B"];\nvar b = configuration.GetSection("C");\ndb.FromSqlRaw("SELECT 1");\n', """
registers_route GET /x :1
uses_config A:B :2
uses_config C :3
touches_table db.FromSqlRaw("SELECT 1"); :4
calls app.MapGet :1
calls configuration.GetSection :3
calls db.FromSqlRaw :4
route = GET /x
config_key = A:B
config_key = C
sql_query = sql
"""),
    ('swift', 'S/a.swift', 'public struct P {\n    let a: Int\n    static func make() -> P { P() }\n}\nprotocol Q {\n}\nextension P {\n    private func x() {\n    }\n}\nenum E { case a }\ntypealias T = Int\nprivate func hid() {}\n', """
struct S.a.P ex 1-4
enum S.a.E ex 11-11
protocol S.a.Q ex 5-6
extension S.a.P ex 7-10
function S.a.hid un 13-13
typealias S.a.T ex 12-12
method S.a.P.make ex 3-3
method S.a.P.x un 8-9
calls make :3
calls x :8
calls hid :13
"""),
    ('swift', 'T/aTests.swift', 'class ATests: XCTestCase {\n    func testload() { load() }\n}\nfunc load() {}\n', """
class T.aTests.ATests ex 1-3
function T.aTests.load ex 4-4
test T.aTests.ATests.testload ex 2-2
calls testload :2
calls load :2
calls load :4
tests load :2
"""),
    ('swift', 'S/b.swift', '/* a /* b */ URLSession */\nlet s = URLSession.shared\nTask { await f() }\nlet p = "SELECT a FROM b"\n', """
touches_table let p = "SELECT a FROM b" :4
invokes_external_api URLSession :2
invokes_external_api Task :3
calls f :3
sql_query = let p = "SELECT a FROM b"
external_service = URLSession
background_job = Task
"""),
    ('lua', 'a/init.lua', 'local M = {}\nfunction M.run(a)\n  if a then\n    for i = 1, 2 do\n      go(i)\n    end\n  end\nend\nfunction M:stop()\n  return\nend\n', """
method a.M.run ex 2-8
method a.M.stop ex 9-11
const a.M un 1-1
calls go :5
calls M.run :2
calls M:stop :9
"""),
    ('lua', 'spec/x_spec.lua', 'describe("x", function()\n  it("adds two", function()\n    add(1)\n  end)\nend)\n', """
test spec.x_spec.adds_two un 2-4
calls describe :1
calls it :2
calls add :3
"""),
    ('lua', 'm.lua', '--[[ os.getenv("NO")\n]]\nlocal function f() return os.getenv("A") end\nngx.timer.at(0, f)\n', """
function m.f un 3-3
uses_config A :3
invokes_external_api ngx.timer.at :4
calls f :3
calls os.getenv :3
calls timer.at :4
env_var = A
background_job = ngx.timer.at
"""),
    ('lua', 'test_m.lua', 'function add()\nend\nfunction test_add()\n  add()\nend\n', """
function test_m.add ex 1-2
test test_m.test_add ex 3-5
calls add :1
calls test_add :3
calls add :4
tests add :3
"""),
    ('go', 'a/a.go', 'package a\n\n// F does.\nfunc F() {}\n\nfunc (t *T) m() {}\n\ntype T struct {\n\tA, b int\n\tE\n}\n\nconst (\n\tX = 1\n\ty = 2\n)\n\nvar Z int\n', """
function a.F ex 4-4
method a.T.m un 6-6
field a.T.A ex 9-9
field a.T.b un 9-9
struct a.T ex 8-11
const a.X ex 14-14
const a.y un 15-15
var a.Z ex 18-18
"""),
    ('go', 'a/a_test.go', 'package a\n\nfunc TestF(t *testing.T) {}\nfunc BenchmarkF(b *testing.B) {}\nfunc F() {}\n', """
test a.TestF ex 3-3
benchmark a.BenchmarkF ex 4-4
function a.F ex 5-5
tests F :3
tests F :4
"""),
    ('go', 'main.go', 'package main\n\nimport (\n\tx "a/b"\n\t_ "c"\n)\n\nfunc main() {\n\tx.Do()\n\tgo x.Run()\n\tlocal()\n}\n\nfunc local() {}\n', """
function main.main un 8-12
function main.local un 14-14
imports a/b :4
imports c :5
calls x.Do :9
calls x.Run :10
calls main.local :11
background_job = x.Run
"""),
    ('go', 'db/m.go', 'package m\n\nfunc up() {\n\tdb.Exec(`CREATE TABLE t (a INT)`)\n\tos.LookupEnv("A")\n\tviper.GetString("b.c")\n}\n', """
function m.up un 3-7
calls db.Exec :4
calls os.LookupEnv :5
calls viper.GetString :6
uses_config A :5
uses_config b.c :6
touches_table CREATE TABLE t (a INT) :4
env_var = A
config_key = b.c
sql_query = CREATE TABLE
"""),
    ('go', 'a.go', 'package a\n\ntype R interface {\n\tRead() int\n\tClose()\n}\ntype F struct{}\nfunc (F) Read() int { return 1 }\nfunc (F) Close() {}\ntype H struct{}\nfunc (H) Read() int { return 1 }\n', """
interface a.R ex 3-6
struct a.F ex 7-7
method a.F.Read ex 8-8
method a.F.Close ex 9-9
struct a.H ex 10-10
method a.H.Read ex 11-11
implements a.R :0
"""),
    ('go', 'r.go', 'package r\n\nfunc f() {\n\tr.GET("/g", h)\n\tmux.Handle("/m", h)\n\thttp.Post(u, t, b)\n\t// http.Get(u)\n}\n', """
function r.f un 3-8
calls r.GET :4
calls mux.Handle :5
calls http.Post :6
registers_route /g :4
registers_route /m :5
registers_route u :6
invokes_external_api http.Post :6
route = GET /g
route = ANY /m
route = POST u
external_service = http.Post
"""),
]


def records(got):
    symbols = [f"{s['symbol_kind']} {s['qualified_name']} {s['visibility'][:2]} {s['start_line']}-{s['end_line']}" for s in got["symbols"]]
    refs = [f"{r['reference_kind']} {r['raw_target_text']} :{r['line']}" for r in got["refs"]]
    return symbols + refs + [f"{a['artifact_kind']} = {a['name']}" for a in got["artifacts"]]


@pytest.mark.parametrize(("language", "path", "text", "want"), CASES)
def test_records(language, path, text, want):
    got = extract_text(path, text, language, "ex.com/s")
    assert got["parse_status"] == "ok" and records(got) == want.strip("\n").split("\n")


@pytest.mark.parametrize("language", sorted({c[0] for c in CASES}))
def test_long_files_take_linear_time(language):
    """Blocks and comments are found in one pass: 20,000 nested or unclosed lines finish at once."""
    line = {"python": "def f():\n", "lua": "function f()\n", "go": "// {\n"}.get(language, "void f() {\n")
    got = extract_text("a/m.x", ("package a\n" if language == "go" else "") + line * 20000, language)
    assert got["parse_status"] == "ok"
