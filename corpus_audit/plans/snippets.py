"""Code snippets that turn the prose of ``documents`` into a small source corpus.

Each entry is (path, text, with_prose).  ``@ID@`` stands for the document id.  With prose, the document
follows the snippet on a new line, so whole documents are scanned.
"""

_LOOP = "for (let i = 0; i < n; i++) { total += i; }\n"
_DUP = "    const shared = computeSomethingLong(alpha);\n"
_WIDE = "x" * 121

SNIPPETS: list[tuple[str, str, bool]] = [
    # control flow
    (
        "src/core/f@ID@.js",
        "function pick(a) {\n  if (a > 1 && a < 9) { return a; }\n  else if (a || b) { return a ? b : c; }\n"
        "  while (a) { a--; }\n  switch (a) { case 1: break; case 2: break; }\n}\n",
        True,
    ),
    ("lib/f@ID@.ts", _LOOP * 2 + "try { go(); } catch (e) { stop(e); }\n", True),
    ("src/core/f@ID@.js", _LOOP * 3 + "const deep = () => { if (a) { if (b) { if (c) { if (d) { if (e) {} } } } } };\n", True),
    (
        "src/core/f@ID@.js",
        "for (const a of rows) { for (const b of cols) { mark(a, b); } }\n"
        "for (const a of rows) { note; for (const b of cols) { } }\n",
        True,
    ),
    (
        "src/core/f@ID@.js",
        "function choose(kind) {\n  switch (kind) {\n    case 1: go(); case 2: run(); case 3: fly();\n  }\n"
        "  if (a) { x } else if (b) x; else if (c) y;\n}\n",
        True,
    ),
    (
        "src/core/f@ID@.js",
        "{ if (a) { if (b) { if (c) { } } } }\n"
        + "on(function (a) { later(function (b) { }); });\n" * 3,
        True,
    ),
    ("src/core/f@ID@.js", "on(function (a) { later(function (b) { }); });\n" * 2 + "const q = a ? b : c;\n", True),
    ("src/core/f@ID@.js", "function long(a) {\n" + "  step(a);\n" * 24 + "}\nfunction brief(a) { return a; }\n", True),
    ("src/core/f@ID@.js", "function huge(a) {\n" + "  step(a);\n" * 33 + "}\n", True),
    (
        "src/core/f@ID@.js",
        "function loud(a) { console.log(a); return a; }\nfunction own() { return this.x; }\n"
        "function local(a) { let b = a; return b; }\nconst keep = (a) => { localStorage.setItem('a', a); };\n"
        "async function save(a) { await fetch('/x'); }\nfunction twice(a) { return '}' + a * 2; }\n",
        True,
    ),
    # literals and layout
    ("src/core/f@ID@.js", "call(first_parameter_name, second_parameter_name, third_one)\n", True),
    ("src/core/f@ID@.js", "call(first_parameter_name, second_parameter_name, third_parameter, fourth)\n", True),
    ("src/core/f@ID@.js", "const a = 42, b = 77, c = 365, d = 5000;\n", True),
    ("src/core/f@ID@.js", "const a = 42, b = 77, c = 2048, d = 10, e = 100, f = 200, g = 404, h = 5001;\n", True),
    ("src/core/f@ID@.js", "// TODO tidy\n/* TODO split */\n// todo later\n", True),
    ("src/core/f@ID@.js", "console.log(1); console.debug(2); console.warn(3);\n", True),
    ("src/core/f@ID@.js", "console.log(1); console.error(2); console.warn(3);\n", True),
    ("src/core/f@ID@.js", (_WIDE + "\n") * 4, True),
    ("src/core/f@ID@.js", ("y" * 120 + "\n") * 2 + _WIDE + "\n", True),
    ("src/core/f@ID@.js", _DUP * 7, True),
    ("src/core/f@ID@.js", _DUP * 6 + "  return alpha;\n" * 9, True),
    ("src/core/f@ID@.js", "say('a long message'); say('a long message'); say('a long message'); say('a long message');\n", True),
    ("src/core/f@ID@.js", 'say("another text"); say("another text"); say("another text");\nconst s = "a" + b;\n', True),
    # state and style
    ("src/ui/f@ID@.ts", "list.push(1); list.pop(); list.shift(); list.unshift(2); list.splice(0, 1);\n", True),
    ("src/ui/f@ID@.ts", "this.a = 1; this.b = 2; view.c = 3; view.d = 4;\n", True),
    ("src/ui/f@ID@.ts", "this.a = 1; Object.assign(view, other); view.c = 3;\nvar old = 1;\n", True),
    ("src/ui/f@ID@.ts", "let a = 1; let b = 2; const c = 3;\nrow[i] = 1; row[j] = 2; row[k] = 3;\n", True),
    (
        "src/ui/f@ID@.ts",
        "const c = [...items]; const d = {...[]}; const e = 5; let f = 1;\nrow[i] = 1; row[j] = 2; row[k] = 3;\n",
        True,
    ),
    ("src/ui/f@ID@.ts", "document.title = 'x';\nfetch('/rows');\nconst v = validate(v0);\n", True),
    ("src/ui/f@ID@.ts", "element.innerHTML = '';\nconst t = transform(u);\n", True),
    ("src/ui/f@ID@.ts", "import { a } from './a';\n" * 11, True),
    ("src/ui/f@ID@.ts", "import { a } from './a';\n" * 9 + "const fs = require('fs');\n", True),
    ("src/ui/f@ID@.ts", "const total = order.customer.address.city;\nif (user.age > 3) { user.old = true; }\n", True),
    (
        "src/ui/f@ID@.ts",
        "if (user.age > 3) { user.old = 1; }\nif (user.age > 4) { user.old = 2; }\nif (user.age > 5) { user.old = 3; }\n",
        True,
    ),
    ("src/ui/f@ID@.ts", "show(a.getName(), a.getAge());\nfunction make(a: string, b: number, c: boolean) { return a; }\n", True),
    (
        "src/ui/f@ID@.ts",
        "if (typeof a === 'string' || typeof b === 'number') {}\n" * 3 + "const k: any = 1; let z: string[] = [];\n",
        True,
    ),
    (
        "src/ui/f@ID@.ts",
        "show(user.name, user.name)\nshow(user.age, user.age)\nshow(user.city, user.city)\nshow(user.zip, user.zip)\n",
        True,
    ),
    ("src/ui/f@ID@.ts", "const { a, b } = props;\nconst t = `hi ${a}`;\nawait load();\nload().then(x => x.y).catch(z => { });\n", True),
    ("src/ui/f@ID@.ts", "load().then(a).then(b).then(c).catch(d);\nload().then(a).then(b);\nasync function go() { }\n", True),
    # security
    (
        "src/f@ID@.js",
        "db.query(`SELECT * FROM t WHERE id = ${id}`);\nexec('ls ' + dir);\nfs.readFile('../' + name);\n",
        True,
    ),
    ("src/f@ID@.js", "const sql = 'SELECT ' +\n  column + ' FROM t';\neval(code);\nconst m = medieval (1);\n", True),
    (
        "src/f@ID@.js",
        'const password = "hunter2hunter2";\nconst apiKey = "abcdefghij12345";\n'
        'const secret = "0123456789abcdef";\nconst token = "0123456789abcdefghijkl";\n',
        True,
    ),
    ("src/f@ID@.js", "const url = process.env.SERVICE_URL;\nconst id = Math.random();\nconst key = 1;\n", True),
    (
        "src/f@ID@.js",
        "if (!process.env.SERVICE_URL) throw new Error('SERVICE_URL missing');\nconst id = Math.random();\n",
        True,
    ),
    ("src/f@ID@.js", "EnvManager.validateEnv('A', process.env.A_KEY);\ntry { go(); } catch (e) { } finally { }\n", True),
    ("src/f@ID@.js", "res.cookie('id', v);\nsave(req.body.name);\n", True),
    ("src/f@ID@.js", "res.cookie('id', v, { secure: true, httpOnly: true });\nsave(sanitize(req.body.name));\n", True),
    ("src/f@ID@.js", "const live = 'sk_live_abcdefghijklmnopqrstuvwx';\nconst blob = 'QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWY=';\n", True),
    # authentication
    ("src/auth/login@ID@.js", "const t = jwt.sign(user, 'secret');\nconst ok = check(password);\n", True),
    ("src/auth/session@ID@.js", "jwt.sign(u, k); jwt.verify(t, k);\nconst h = bcrypt.hash(password);\nconst session = require('express-session');\n", True),
    (
        "src/middleware/auth-middleware@ID@.ts",
        "app.use(session({ resave: false, saveUninitialized: false })); // express-session\napp.post('/x', csrf());\n",
        True,
    ),
    # routes and API
    (
        "src/routes/route@ID@.js",
        "router.get('/a', h);\nrouter.post('/b', (req, res) => { users.save(req.body); });\napp.delete('/c', h);\n"
        "User.load(req.params.id).find(1); req.query.x.update(1);\n",
        True,
    ),
    (
        "src/api/api@ID@.ts",
        "/**\n * @swagger\n */\napp.get('/a', async (req, res) => { try { res.json(validate(req.query)); } catch (e) { next(error); } });\n"
        "const s = joi.object();\n",
        True,
    ),
    ("src/controllers/controller@ID@.js", "const express = require('express');\nconst app = express();\napp.listen(80);\n", True),
    (
        "src/api/users-api@ID@.js",
        "router.get('/me', isAuthenticated, (req, res) => { res.json(req.user); });\ncheck('name');\n"
        "router.post('/x', (req, res) => { passport.authenticate(); throw new Error('x'); });\n",
        True,
    ),
    # documentation and symbols
    ("docs/setup@ID@.md", "# Setup\n\nHow to configure and install.\n", True),
    (
        "src/core/f@ID@.js",
        "/** Adds. */\nfunction add(a, b) { return a + b; }\n\n\n\nexport const minus = (a, b) => a - b;\n",
        True,
    ),
    (
        "src/core/f@ID@.js",
        "/**\n * One.\n */\nclass Store extends Base {\n  load(id) {\n    return this.rows[id];\n  }\n  async saveAll(rows) {\n    return rows;\n  }\n}\n",
        True,
    ),
    # tests
    ("src/core/f@ID@.test.js", "describe('x', () => { it('a', () => { assert(1); }); it('b', () => {}); });\n", True),
    ("tests/f@ID@.spec.ts", "test('a', () => { expect(1); });\n", True),
    # noise and root files
    ("node_modules/pkg/f@ID@.js", "var a = 1; eval(a);\n", True),
    ("README.md", "# Project @ID@\n\nAn overview and description of the project.\n\n## Install\n\nUsage example and API.\n", True),
    (
        "package.json",
        '{"name": "p@ID@", "main": "src/main@ID@.js", "scripts": {"test": "jest", "test:unit": "jest unit"},\n'
        ' "dependencies": {"express": "^4.17.0", "lodash": "1.2.3", "left-pad": "^0.9.1"},\n'
        ' "devDependencies": {"jest": "~29.0.0", "lodash": "^4.17.21"}}\n',
        False,
    ),
    (".env", "API_KEY=abc@ID@ # note\nSERVICE_URL = \"https://example.org/@ID@\"\nEMPTY=\nTIMEOUT=30\nTIMEOUT=60\nnot a line\n", False),
    (".gitignore", "# ignored\ndocs/**\n\n*.test.js\ncontrollers/\n**/session*.js\n", False),
    ("tsconfig.json", '{"compilerOptions": {"strict": true}}\n', False),
    ("index.js", "const yargs = require('yargs');\nconst p = process.argv;\n", True),
    ("src/index.ts", "import app from './app';\nhttp.createServer(app);\n", True),
    ("Dockerfile", "FROM node\nENV NODE_ENV=production\n", True),
    ("swagger.yaml", "openapi: 3.0.0\n", True),
    ("config/app.config.json", '{"port": 80}\n', True),
]
