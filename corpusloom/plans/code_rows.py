"""A small repository in literal rows: fixture texts hold no code."""

FILES = [
    ("src/index.ts", "import { helper, Base } from './utils.js';\nimport express from 'express';\nexport class App extends Base {\n}\nexport function main(a, b) {\n  helper(a);\n  unknown(b);\n}\napp.use(helper);\napp.get('/items', list);\nbus.on('ready', main);\nbus.emit('done', 1);\n"),
    ("src/utils.ts", "export function helper(x) {\n  return fs.readFile(x);\n}\nexport class Base {\n}\nfunction lonely() {\n  // TODO finish\n  console.log('x');\n}\nexport const add = (p, q) => p + q;\n"),
    ("src/api/routes.ts", "import { main } from '../index';\nimport './side';\nimport { add } from '../utils';\nrouter.post(\"/items\", main);\n@Get('/health')\nmap.get('key');\nserver.use(main);\nother.use(main);\nconst rows = db.query('select 1');\nbus.once('done', f);\nfs.writeFileSync('a', rows);\n"),
    ("src/side/index.ts", "export const sideValue = async function (z) {};\nlet unusedThing = 4;\ntry { go(); } catch (e) { }\nlet v: any = 1;\n"),
    ("src/index.test.ts", "import { main } from './index';\nmain(1, 2);\n"),
    ("tests/deep.ts", "import { helper } from '../src/utils';\nhelper(1);\n"),
    ("db/schema.sql", "CREATE TABLE users (id int);\ncreate table if not exists \"orders\" (id int);\n"),
    ("prisma/schema.prisma", "model User {\n}\nmodel Post {\n}\n"),
]
PATHS = [
    (".github/workflows/ci.yml",), (".gitlab-ci.yml",), ("Dockerfile",), ("docker-compose.dev.yaml",), ("db/x.sql",), ("a/schema.graphql",), ("README.md",), ("docs/a.rst",), ("package.json",),
    ("tsconfig.build.json",), ("conf/app.yaml",), ("vite.config.ts",), (".eslintrc",), ("src/main.ts",), ("node_modules/x/index.js",), ("dist/a.js",), ("yarn.lock",), ("src/deep/tool.py",), ("img/logo.png",), ("src/node_modules.ts",),
]
#: (path, name, kind, exported)
SYMBOLS = [
    ("src/index.ts", "App", "class", True), ("src/index.ts", "main", "function", True), ("src/utils.ts", "helper", "function", True), ("src/utils.ts", "Base", "class", True),
    ("src/utils.ts", "lonely", "function", False), ("src/utils.ts", "add", "function", True), ("src/side/index.ts", "sideValue", "function", True),
]
#: (path, source, line)
IMPORTS = [
    ("src/index.ts", "./utils.js", 1), ("src/index.ts", "express", 2), ("src/api/routes.ts", "../index", 1), ("src/api/routes.ts", "./side", 2), ("src/api/routes.ts", "../side", 4),
    ("src/api/routes.ts", "../utils", 3), ("src/index.test.ts", "./index", 1), ("tests/deep.ts", "../src/utils", 1), ("tests/deep.ts", "./../src/./index.ts", 2),
]
#: (path, source, item)
ITEMS = [("src/index.ts", "./utils.js", "helper"), ("src/index.ts", "./utils.js", "Base"), ("src/index.ts", "express", "express"), ("src/api/routes.ts", "../index", "main"), ("src/api/routes.ts", "../side", None), ("src/api/routes.ts", "../utils", "add"), ("src/api/routes.ts", "../utils", "missing"), ("src/index.test.ts", "./index", "main"), ("tests/deep.ts", "../src/utils", "helper")]
#: (path, caller, callee)
CALLS = [("src/index.ts", "main", "helper"), ("src/index.ts", "main", "unknown"), ("src/index.ts", "main", "main"), ("src/api/routes.ts", "setup", "main"), ("src/api/routes.ts", "setup", "add"), ("src/utils.ts", "add", "helper"), ("src/index.test.ts", "case1", "main")]
INHERITS = [("src/index.ts", "App", "Base", "inherits"), ("src/index.ts", "App", "Unknown", "implements"), ("src/utils.ts", "Base", "Base", "inherits"), ("src/index.ts", "App", "Base", "implements")]
EXPORTS = [("src/index.ts", "App", "class"), ("src/index.ts", "main", "function"), ("src/utils.ts", "answer", "variable"), ("src/utils.ts", "helper", "default")]
