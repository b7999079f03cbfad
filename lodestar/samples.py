"""Small source texts, one for each language, that the rows-only extraction queries run over."""

SAMPLES = {
    "typescript": ("src/routes/orders.test.ts", "import { db } from './db';\n// app.get('/hidden', h)\napp.get('/orders', list)\nconst url = process.env.API_URL;\nconst q = `SELECT id FROM orders WHERE total > 10`;\nexport function list() { return fetch('https://api.example.com/orders') }\nnew Worker('w.js')\ndescribe('list', () => {})\n"),
    "javascript": ("web/app.spec.js", "import express from 'express';\nrouter.post('/carts', add)\nfunction add() { return axios.get('https://api.example.com') }\nclass Cart {\n  total() { return config.get('cart.tax') }\n}\ntest('add', () => {})\n"),
    "python": ("app/test_orders.py", "import os\nfrom app import db\n# @app.get('/hidden')\n@app.get('/orders')\ndef orders():\n    key = os.getenv('API_KEY')\n    db.execute('SELECT id FROM orders WHERE total > 10')\n    requests.get('https://api.example.com')\n    asyncio.create_task(go())\nTAX_RATE = 2\ndef test_orders():\n    orders()\n"),
    "rust": ("src/orders.rs", "use db::pool;\n#[get(\"/orders\")]\npub fn orders() {\n  std::env::var(\"API_KEY\");\n  sqlx::query!(\"SELECT id FROM orders\");\n  reqwest::get(url);\n  tokio::spawn(go());\n}\nmod tests {\n    #[test]\n    fn test_orders() { orders(); }\n}\n"),
    "java": ("src/Orders.java", "package com.example.shop;\nimport com.example.Db;\npublic class Orders {\n    public static final int MAX = 5;\n    @GetMapping(\"/orders\")\n    public String list() { System.getenv(\"API_KEY\"); run(\"SELECT id FROM orders\"); return webClient.uri(\"https://api\"); }\n    @Async\n    void go() { }\n    @Test\n    public void testList() { list(); }\n}\n"),
    "csharp": ("Api/Orders.cs", "namespace Shop.Api;\nusing System;\npublic class Orders\n{\n    [HttpGet(\"/orders\")]\n    public string List() { Environment.GetEnvironmentVariable(\"API_KEY\"); return Db(\"SELECT id FROM orders\"); }\n    public void Go() { Task.Run(() => new HttpClient()); }\n    [Fact]\n    public void TestList() { List(); }\n}\n"),
    "swift": ("Sources/orders.swift", "import Vapor\nclass Orders {\n    func list() { Environment.get(\"API_KEY\"); db(\"SELECT id FROM orders\"); URLSession.shared.load(u) }\n    func testlist() { list() }\n}\nfunc routes() {\n app.get(\"orders\")\n Task { }\n}\n"),
    "lua": ("spec/orders_spec.lua", "local db = require(\"db\")\nfunction orders()\n  os.getenv(\"API_KEY\")\n  db.query(\"SELECT id FROM orders\")\n  http.request(u)\n  ngx.timer.at(0)\nend\nfunction Cart:add()\nend\nlocal TAX = 1\napp:get(\"/orders\", orders)\nfunction test_orders()\n  orders()\nend\n"),
    "go": ("cmd/shop/main.go", "package main\n\nimport \"os\"\n\ntype Store interface{ List() []string }\ntype mem struct{ n int }\n\nfunc (m *mem) List() []string { return nil }\n\n// main starts the shop.\nfunc main() {\n\thttp.HandleFunc(\"/orders\", list)\n\tos.Getenv(\"API_KEY\")\n\tdb.Query(\"SELECT id FROM orders\")\n\thttp.Get(url)\n\tgo run()\n}\nfunc TestList(t *testing.T) {}\n"),
}

#: Sources made from a number and a text (in a comment), and what each must yield: what, kind, name, first and last line.
GENERATED = {
    "python": ("app/mod_{i}.py", (
        '# {text}\n'
        'import os\n'
        'from lib{i} import x\n'
        "@app.get('/p{i}')\n"
        'def load_{i}():\n'
        "    key = os.getenv('KEY_{i}')\n"
        '    helper_{i}(key)\n'
        'class Box_{i}:\n'
        '    def _open(self):\n'
        '        pass\n'
        'LIMIT_{i} = 3\n'
    ), """
symbol|function|app.mod_{i}.load_{i}|5|7
symbol|class|app.mod_{i}.Box_{i}|8|10
symbol|method|app.mod_{i}.Box_{i}._open|9|10
symbol|const|app.mod_{i}.LIMIT_{i}|11|11
symbol|decorator|app.mod_{i}.@app.get|4|4
reference|imports|os|2|0
reference|imports|lib{i}|3|0
reference|registers_route|/p{i}|4|0
reference|uses_config|KEY_{i}|6|0
reference|calls|load_{i}|5|0
reference|calls|helper_{i}|7|0
reference|calls|_open|9|0
reference|calls|app.get|4|0
reference|calls|os.getenv|6|0
artifact|route|GET /p{i}|0|0
artifact|env_var|KEY_{i}|0|0
"""),
    "typescript": ("web/mod_{i}.ts", (
        '// {text}\n'
        "import { a } from 'lib{i}';\n"
        "app.post('/p{i}', h);\n"
        'export function load_{i}() {\n'
        '  const key = process.env.KEY_{i};\n'
        '  return helper_{i}(key);\n'
        '}\n'
        'export class Box_{i} {\n'
        "  open_{i}() { return fetch('http://h{i}') }\n"
        '}\n'
    ), """
symbol|function|web/mod_{i}.load_{i}|4|7
symbol|class|web/mod_{i}.Box_{i}|8|10
symbol|method|web/mod_{i}.Box_{i}.open_{i}|0|0
reference|imports|lib{i}|2|0
reference|registers_route|/p{i}|3|0
reference|uses_config|KEY_{i}|5|0
reference|invokes_external_api|http://h{i}|9|0
reference|calls|load_{i}|4|0
reference|calls|helper_{i}|6|0
reference|calls|open_{i}|9|0
reference|calls|fetch|9|0
reference|calls|app.post|3|0
artifact|route|POST /p{i}|0|0
artifact|env_var|KEY_{i}|0|0
artifact|external_service|fetch|0|0
"""),
    "rust": ("src/mod_{i}.rs", (
        '// {text}\n'
        'use lib{i}::x;\n'
        '#[put("/p{i}")]\n'
        'pub fn load_{i}() {\n'
        '  env::var("KEY_{i}");\n'
        '  helper_{i}();\n'
        '}\n'
        'struct Box_{i} {\n'
        '}\n'
        'impl Box_{i} {\n'
        '    pub fn open_{i}(&self) {}\n'
        '}\n'
        'mod tests {\n'
        '    #[test]\n'
        '    fn test_load_{i}() {}\n'
        '}\n'
    ), """
symbol|function|src::mod_{i}::load_{i}|4|7
symbol|struct|src::mod_{i}::Box_{i}|8|9
symbol|method|src::mod_{i}::Box_{i}::open_{i}|11|11
symbol|module|src::mod_{i}::tests|13|0
symbol|test|src::mod_{i}::test_load_{i}|15|15
reference|imports|lib{i}::x|2|0
reference|registers_route|/p{i}|3|0
reference|uses_config|KEY_{i}|5|0
reference|calls|put|3|0
reference|calls|load_{i}|4|0
reference|calls|helper_{i}|6|0
reference|calls|open_{i}|11|0
reference|calls|test_load_{i}|15|0
reference|calls|env::var|5|0
reference|tests|load_{i}|15|0
artifact|route|PUT /p{i}|0|0
artifact|env_var|KEY_{i}|0|0
"""),
    "java": ("src/Box_{i}.java", (
        '// {text}\n'
        'package com.p{i};\n'
        'import lib{i}.X;\n'
        'public class Box_{i} {\n'
        '    static final int LIMIT_{i} = 1;\n'
        '    @GetMapping("/p{i}")\n'
        '    public String load_{i}() {\n'
        '        return run_{i}(System.getenv("KEY_{i}"));\n'
        '    }\n'
        '    @Test\n'
        '    public void testLoad() {\n'
        '    }\n'
        '}\n'
    ), """
symbol|class|com.p{i}.Box_{i}|4|13
symbol|const|com.p{i}.Box_{i}.LIMIT_{i}|5|5
symbol|method|com.p{i}.Box_{i}.load_{i}|7|9
symbol|method|com.p{i}.Box_{i}.run_{i}|8|8
symbol|test|com.p{i}.Box_{i}.testLoad|11|12
reference|imports|lib{i}.X|3|0
reference|registers_route|/p{i}|6|0
reference|uses_config|KEY_{i}|8|0
reference|calls|load_{i}|7|0
reference|calls|run_{i}|8|0
reference|calls|testLoad|11|0
reference|calls|System.getenv|8|0
artifact|route|GET /p{i}|0|0
artifact|env_var|KEY_{i}|0|0
"""),
    "csharp": ("Api/Box_{i}.cs", (
        '// {text}\n'
        'namespace P{i};\n'
        'using Lib{i};\n'
        'public class Box_{i}\n'
        '{\n'
        '    [HttpGet("/p{i}")]\n'
        '    public string Load_{i}()\n'
        '    {\n'
        '        return run_{i}(Environment.GetEnvironmentVariable("KEY_{i}"));\n'
        '    }\n'
        '}\n'
    ), """
symbol|class|P{i}.Box_{i}|4|11
symbol|method|P{i}.Box_{i}.Load_{i}|7|10
symbol|method|P{i}.Box_{i}.run_{i}|9|9
reference|imports|Lib{i}|3|0
reference|registers_route|GET /p{i}|6|0
reference|uses_config|KEY_{i}|9|0
reference|calls|run_{i}|9|0
reference|calls|Environment.GetEnvironmentVariable|9|0
artifact|route|GET /p{i}|0|0
artifact|env_var|KEY_{i}|0|0
"""),
    "swift": ("Sources/mod_{i}.swift", (
        '// {text}\n'
        'import Lib{i}\n'
        'class Box_{i} {\n'
        '    func load_{i}() {\n'
        '        helper_{i}(Environment.get("KEY_{i}"))\n'
        '    }\n'
        '}\n'
        'func routes_{i}() {\n'
        '    app.get("p{i}")\n'
        '}\n'
    ), """
symbol|class|Sources.mod_{i}.Box_{i}|3|7
symbol|function|Sources.mod_{i}.routes_{i}|8|10
symbol|method|Sources.mod_{i}.Box_{i}.load_{i}|4|6
reference|imports|Lib{i}|2|0
reference|registers_route|GET p{i}|9|0
reference|uses_config|KEY_{i}|5|0
reference|calls|load_{i}|4|0
reference|calls|helper_{i}|5|0
reference|calls|routes_{i}|8|0
reference|calls|Environment.get|5|0
reference|calls|app.get|9|0
artifact|route|GET p{i}|0|0
artifact|env_var|KEY_{i}|0|0
"""),
    "lua": ("lib/mod_{i}.lua", (
        '-- {text}\n'
        'local m = require("lib{i}")\n'
        'function load_{i}()\n'
        '  helper_{i}(os.getenv("KEY_{i}"))\n'
        'end\n'
        'function Box_{i}:open()\n'
        'end\n'
        'local LIMIT_{i} = 1\n'
    ), """
symbol|function|lib.mod_{i}.load_{i}|3|5
symbol|method|lib.mod_{i}.Box_{i}.open|6|7
symbol|const|lib.mod_{i}.LIMIT_{i}|8|8
reference|imports|lib{i}|2|0
reference|uses_config|KEY_{i}|4|0
reference|calls|require|2|0
reference|calls|load_{i}|3|0
reference|calls|helper_{i}|4|0
reference|calls|os.getenv|4|0
reference|calls|Box_{i}:open|6|0
artifact|env_var|KEY_{i}|0|0
"""),
    "go": ("cmd/m{i}/main.go", (
        '// {text}\n'
        '\n'
        'package m{i}\n'
        '\n'
        'import "lib{i}"\n'
        '\n'
        'type Box_{i} struct {\n'
        '\tsize int\n'
        '}\n'
        '\n'
        'func (b *Box_{i}) Open() int {\n'
        '\treturn helper_{i}(os.Getenv("KEY_{i}"))\n'
        '}\n'
        '\n'
        'func routes_{i}() {\n'
        '\thttp.HandleFunc("/p{i}", h)\n'
        '}\n'
    ), """
symbol|field|m{i}.Box_{i}.size|8|8
symbol|struct|m{i}.Box_{i}|7|9
symbol|method|m{i}.Box_{i}.Open|11|13
symbol|function|m{i}.routes_{i}|15|17
reference|imports|lib{i}|5|0
reference|calls|m{i}.helper_{i}|12|0
reference|calls|os.Getenv|12|0
reference|calls|http.HandleFunc|16|0
reference|registers_route|/p{i}|16|0
reference|uses_config|KEY_{i}|12|0
artifact|route|ANY /p{i}|0|0
artifact|env_var|KEY_{i}|0|0
"""),
}

#: Sources made from a number and a text for the relations of a file: what each must yield of migrations, SQL, services,
#: jobs, tests and implementations: what, kind, name, line, confidence, and an artifact's data or a reference's two ends.
RELATIONS = {
    "python": ("db/migrations/test_mod_{i}.py", (
        '# {text}\n'
        'import requests\n'
        'class Order_{i}:\n'
        '    def load_{i}(self):\n'
        "        cursor.execute('SELECT id FROM orders_{i} WHERE total = 10')\n"
        "        requests.get('https://api{i}.example.com/x')\n"
        '\n'
        '@shared_task\n'
        'def send_{i}():\n'
        '    pass\n'
        '\n'
        'def test_send_{i}():\n'
        '    send_{i}()\n'
    ), """
reference|migrates|db/migrations/test_mod_{i}.py|1|exact|
reference|touches_table|SELECT id FROM orders_{i} WHERE total = 10|5|heuristic|
reference|invokes_external_api|requests.get|6|heuristic|
reference|tests|send_{i}|12|heuristic|db.migrations.test_mod_{i}.test_send_{i} -> db.migrations.test_mod_{i}.send_{i}
artifact|migration|db/migrations/test_mod_{i}.py|0|exact|{"file":"db/migrations/test_mod_{i}.py","type":"migration"}
artifact|sql_query|SELECT id FROM orders_{i} WHERE total = 10|0|heuristic|{"query":"SELECT id FROM orders_{i} WHERE total = 10"}
artifact|external_service|requests.get|0|heuristic|{"source":"requests.get","type":"http_client"}
artifact|background_job|app.task|0|heuristic|{"name":"app.task","type":"celery_task"}
"""),
    "typescript": ("db/migrations/mod_{i}.test.ts", (
        '// {text}\n'
        "import axios from 'axios';\n"
        'const q = `SELECT id FROM orders_{i} WHERE total = 10`;\n'
        "queue.process('send_{i}', run);\n"
        "new Worker('work_{i}');\n"
        "axios.post('https://api{i}.example.com/x');\n"
    ), """
reference|migrates|db/migrations/mod_{i}.test.ts|0|exact|
reference|touches_table|SELECT id FROM orders_{i} WHERE total = 10|3|heuristic|
reference|invokes_external_api|https://api{i}.example.com/x|6|heuristic|
artifact|migration|db/migrations/mod_{i}.test.ts|0|exact|{"file":"db/migrations/mod_{i}.test.ts","type":"migration"}
artifact|sql_query|SELECT|0|heuristic|{"query":"SELECT id FROM orders_{i} WHERE total = 10","type":"SELECT"}
artifact|external_service|axios.post|0|heuristic|{"source":"axios.post","type":"http_client"}
artifact|background_job|Worker|0|heuristic|{"name":"Worker","type":"worker"}
artifact|background_job|Queue|0|heuristic|{"name":"Queue","type":"queue"}
"""),
    "go": ("db/migrations/mod_{i}.go", (
        '// {text}\n'
        'package store\n'
        '\n'
        'type Stored_{i} interface{ List() []string }\n'
        '\n'
        'type mem_{i} struct{ n int }\n'
        '\n'
        'func (m *mem_{i}) List() []string { return nil }\n'
        '\n'
        'func load_{i}() {\n'
        '\tdb.Query("SELECT id FROM orders_{i} WHERE total = 10")\n'
        '\tdb.Exec("CREATE TABLE carts_{i} (id int)")\n'
        '\thttp.Get("https://api{i}.example.com/x")\n'
        '\tgo run_{i}()\n'
        '}\n'
    ), """
reference|implements|store.Stored_{i}|0|exact|store.mem_{i} -> store.Stored_{i}
reference|migrates|db/migrations/mod_{i}.go|0|exact|
reference|touches_table|SELECT id FROM orders_{i} WHERE total = 10|11|heuristic|
reference|touches_table|CREATE TABLE carts_{i} (id int)|12|heuristic|
reference|invokes_external_api|http.Get|13|heuristic|
artifact|migration|db/migrations/mod_{i}.go|0|exact|{"file":"db/migrations/mod_{i}.go","type":"migration"}
artifact|sql_query|SELECT|0|heuristic|{"query":"SELECT id FROM orders_{i} WHERE total = 10","type":"SELECT"}
artifact|sql_query|CREATE TABLE|0|heuristic|{"query":"CREATE TABLE carts_{i} (id int)","type":"CREATE TABLE"}
artifact|external_service|http.Get|0|heuristic|{"source":"http.Get","type":"http_client"}
artifact|background_job|run_{i}|0|heuristic|{"name":"run_{i}","type":"goroutine"}
"""),
    "java": ("src/flyway/Box_{i}.java", (
        '// {text}\n'
        'package com.p{i};\n'
        'public class Box_{i} {\n'
        '    @Async\n'
        '    void send_{i}() {\n'
        '        jdbc.query("SELECT id FROM orders_{i} WHERE total = 10");\n'
        '        restTemplate.getForObject("https://api{i}.example.com/x", String.class);\n'
        '    }\n'
        '    @Test\n'
        '    public void testSend_{i}() {\n'
        '    }\n'
        '}\n'
    ), """
reference|migrates|src/flyway/Box_{i}.java|0|exact|
reference|touches_table|SELECT id FROM orders_{i} WHERE total = 10|6|heuristic|
reference|invokes_external_api|https://api{i}.example.com/x|7|heuristic|
reference|tests|send_{i}|10|heuristic|com.p{i}.Box_{i}.testSend_{i} -> com.p{i}.send_{i}
artifact|migration|src/flyway/Box_{i}.java|0|exact|{"file":"src/flyway/Box_{i}.java","type":"migration"}
artifact|sql_query|SELECT|0|heuristic|{"query":"SELECT id FROM orders_{i} WHERE total = 10","type":"SELECT"}
artifact|external_service|RestTemplate.getForObject|0|heuristic|{"source":"RestTemplate.getForObject","type":"http_client"}
artifact|background_job|@Async|0|heuristic|{"name":"@Async","type":"async"}
"""),
}
