"""Short code texts, one per rule family, that the test views put before each document.

Twelve per language; ``doc_id % 12`` picks one, ``doc_id % 7`` the language.
"""

from __future__ import annotations


def _lines(*rows: str) -> str:
    return "\n".join(rows)


def _cs_god() -> str:
    body = [f"    public int Step{i}(int a) {{ return a + {i}; }}" for i in range(1, 22)]
    return _lines("namespace Shop.Core.Models", "{", "public class OrderHub", "{", *body, "}", "}")


def _cs_long() -> str:
    body = [f"        total = total + Weigh({i});" for i in range(1, 56)]
    return _lines("using System;", "namespace Shop.Core.Batch", "{", "public class Ledger", "{",
                  "    private int Weigh(int n)", "    {", "        return n;", "    }",
                  "    public int Sum(int total)", "    {", *body, "        return total;", "    }", "}", "}")


CSHARP = [
    _lines("using System;", "using Shop.Data;", "namespace Shop.Security", "{", "public class Login", "{",
           '    private string Password = "hunter2-hunter2";',
           "    public bool Check(string user, string pass, int tries, bool strict)", "    {",
           "        if (tries > 3 && strict) { return false; }",
           "        LogError(\"Token \" + pass);", "        return user == pass;", "    }", "}", "}"),
    _lines("using System.Data.OleDb;", "using System.Linq;", "namespace Shop.Data.Repository", "{",
           "public class OrderStore : OrderHub", "{",
           "    public string Find(string name)", "    {",
           '        var sql = "SELECT * FROM orders WHERE n = " + name;',
           "        var c = new SqlConnection (sql);", "        DataSet rows = Load(sql);",
           "        return rows.Result;", "    }", "}", "}"),
    _lines("using System;", "namespace Shop.Services", "{", "public class Mailer", "{",
           "    public void Send(string to)", "    {", "        try { Post(to); }", "        catch (Exception)", "        {",
           "        }", "        // TODO retry", "    }", "    private void Unused(int n)", "    {", "        Wait(n);", "    }",
           "    private void Post(string to)", "    {", "        Thread.Sleep(100);", "    }", "}", "}"),
    _lines("using System.Web.UI;", "using System.Web.Services;", "using System.Runtime.Remoting;",
           "namespace Shop.Web.Pages", "{", "public class CartPage : OrderHub, System.Web.UI.IPage", "{",
           "    public void Load(int id)", "    {", "        var who = HttpContext.Current.User;",
           "        var old = new BinaryFormatter ();", "        WebClient web = new WebClient();",
           "        Process.Start (\"calc\");", "        ProcessOrder(id);", "    }",
           "    [Obsolete(\"old\")]", "    public void ProcessOrder(int id)", "    {", "        Session[\"id\"] = id;", "    }",
           "}", "}"),
    _lines("using System;", "namespace Shop.Common", "{", "public static class Settings", "{",
           "    public static int Retries = 7;", "    public static string Host = \"local\";",
           "    public static int Port = 1024;", "    public static int Days = 365;",
           "    public static readonly string Name = \"shop\";",
           "    public static int Read(string key) { return Retries * 60; }",
           "    public static int Write(string key) { return Port; }", "}", "}"),
    _lines("using System;", "namespace Shop.Domain", "{", "public class Timer", "{",
           "    public int Seconds { get; set; }", "    public string Zone { get; }",
           "    public int ToDay(int h)", "    {", "        int day = h * 3600;", "        if (h > 24 || h == 60)", "        {",
           "            return day + 86400;", "        }", "        return day / 100;", "    }", "}", "}"),
    _lines("using System;", "namespace Shop.Loops", "{", "public class Report", "{",
           "    public void Build(object rows)", "    {",
           "        foreach (var r in rows) { db.Query (r); var x = new Row (r); }",
           "        for (int i = 0; i < 9; i++) { try { A(); } catch { } }",
           "        try { B(); } catch { Log(); }", "        try { C(); } catch { Log(); }", "        try { D(); } catch { Log(); }",
           "        var t = Type.GetType (\"x\"); File.ReadAllText (path);", "    }", "}", "}"),
    _cs_god(),
    _cs_long(),
    _lines("using Shop.A;", "using Shop.B;", "using Shop.C;", "using Shop.D;", "using Shop.E;", "using Shop.F;",
           "using Shop.G;", "using Shop.H;", "using Shop.I;", "using Shop.J;", "using Shop.K;", "namespace Shop.Tree", "{",
           "// " + " ".join(["Node"] * 13),
           "public class Node { }", "public class Branch : Node { }", "public class Twig : Branch { }",
           "public class Leaf : Twig { }", "public class Bud : Leaf { }", "public interface IGrow { }", "}"),
    _lines("using System;", "namespace Shop.Envy", "{", "public class Price", "{", "    public int Value { get; set; }", "}",
           "public class Helper { }", "public class Basket", "{",
           "    public int Total(int n)", "    {",
           "        var a = new Price(); var b = new Price(); var c = new Price(); var d = new Price();",
           "        var e = new Helper(); var f = new Price();",
           "        return a.Value + b.Value + Price.Default;", "    }", "}", "}"),
    _lines("using System;", "namespace Shop.Clean", "{", "public class OrderController", "{",
           "    public event Changed OnChanged;", "    private int count;", "    private int limit;", "    private int low;",
           "    private int high;", "    public int Count { get; set; }", "    public int Limit { get; set; }",
           "    [HttpPost] public ActionResult Save(int id) { return Ok(id); }",
           "    public int Validate(int a) { return a; }", "    public int Calculate(int a) { return a; }",
           "    public async Task Run(int a) { await Go(a); }", "}", "}"),
]

PYTHON = [
    _lines("import os", "from app.Services import Unit11", "class Login(Base):", "    def check(self, user, password):",
           "        api_key = 'abcdef0123456789abcdef'", "        if user == 'admin':", "            return eval(password)",
           "        if len(password) < 4:", "            return None"),
    _lines("import sqlite3", "def find(name):",
           "    sql = f\"SELECT * FROM t WHERE n = '{name}'\"", "    return db.execute(sql)"),
    _lines("import pickle, subprocess", "def load(path):", "    try:", "        return pickle.load(open(path))",
           "    except Exception:", "        pass", "def _unused(n):", "    # TODO drop", "    return n"),
    _lines("import random", "total = 0", "class Draw:", "    def pick(self, xs):",
           "        value = random.choice(xs)", "        return value", "    print \"old style\""),
    _lines("from typing import List", "LIMIT = 100", "def walk(rows: List):", "    for row in rows:",
           "        out += row", "    return out"),
    _lines("import requests", "def pull(urls):", "    for u in urls:", "        r = requests.get(u)", "    return r",
           "def day(h):", "    return h * 3600 + 24"),
    _lines("def grid(a):", "    for i in a:", "        for j in a:", "            for k in range(10):",
           "                print(i)", "    return [x for x in range(100000)]"),
    _lines("class Hub:", *[f"    def step{i}(self, a):\n        return a + {i}" for i in range(1, 22)]),
    _lines("def long_one(a):", *[f"    a = a + {i}" for i in range(1, 56)], "    return a"),
    _lines("from app.Models.Unit7 import x", "from os.path import *", "class Node(object):", "    pass",
           "class Leaf(Node):", "    def grow(self):", "        helper = MailService(1)", "        return helper.run()"),
    _lines("import json", "class Parse(Unit):", "    async def run(self, text):", "        data = payload[0]",
           "        return \"%s\" % data"),
    _lines("from dataclasses import dataclass", "def add(a: int, b: int) -> int:", "    return a + b"),
]

JAVASCRIPT = [
    _lines("import fs from 'fs';", "import { go } from 'app/Services/Unit11';", "class Login extends Base {",
           "  check(user, pass) {", "    const token = 'abcdef0123456789abcdef';", "    if (user == 'admin') { return eval(pass); }",
           "    if (password.length < 4) { return null; }", "  }", "}"),
    _lines("const db = require('db');", "function find(name) {",
           "  const sql = `SELECT * FROM t WHERE n = ${name}`;", "  return db.query(sql);", "}"),
    _lines("function load(path) {", "  try { return open(path); }", "  catch (e) {", "  }", "}",
           "function unused(n) {", "  // FIXME drop", "  return n;", "}"),
    _lines("var total = 0;", "var t = new MailService(1);", "document.body.innerHTML = '<b>' + name;",
           "a(function (x) { b(function (y) { c(function (z) { }); }); });"),
    _lines("let limit = 100;", "function walk(rows) {", "  for (let i = 0; i < 9; i++) { out += rows[i]; }", "  return out;", "}"),
    _lines("function pull(urls) {", "  for (const u of urls) { r = db.query (u); }", "  return api.findAll ();", "}",
           "function day(h) {", "  return h * 3600 + 24;", "}"),
    _lines("for (a of b) { for (c of d) { for (e of f) { g(); } } }",
           "p.then(a => { q.then(b => { r.then(c => c); }); });"),
    _lines("class Hub {", *[f"  step{i}(a) {{ return a + {i}; }}" for i in range(1, 22)], "}"),
    _lines("function longOne(a) {", *[f"  a = a + {i};" for i in range(1, 56)], "  return a;", "}"),
    _lines("import * as m from 'app/Models/Unit7';", "class Node {", "}", "class Leaf extends Node {",
           "  grow() {", "    return new Node();", "  }", "}"),
    _lines("import x from './unit1';", "class Parse extends Unit {", "  async run(text) {", "    return validate(text);", "  }", "}"),
    _lines("function add(a, b) {", "  return check(a) + b;", "}"),
]

JAVA = [
    _lines("package shop.security;", "import java.util.*;", "import app.Services.Unit11;", "public class Login extends Base {",
           "    public boolean check(String user, int tries) {", "        String password = \"hunter2-hunter2\";",
           "        if (user == \"admin\") { return true; }", "        return eval(password);", "    }", "}"),
    _lines("package shop.data;", "public class Store {", "    public String find(String name) {",
           "        String sql = \"SELECT * FROM t WHERE n = \" + name + \"{\";", "        return db.query(sql);", "    }", "}"),
    _lines("package shop.services;", "public class Mailer {", "    public void send(String to) {",
           "        try { post(to); } catch (Exception e) { }", "    }", "    private void unused(int n) {", "        stop(n);", "    }", "}"),
    _lines("package shop.web;", "import app.Models.Unit7;", "public class Cart {", "    public static int retries = 7;",
           "    public static String host = \"x\";", "    public void load(int id) {",
           "        ArrayList rows = new ArrayList();", "        OrderService s = new OrderService();", "    }", "}"),
    _lines("package shop.tree;", "public class Node {", "}", "class Leaf extends Node implements Grow {", "}"),
    _lines("package shop.loops;", "public class Report {", "    public int build(int n) {",
           "        for (int i = 0; i < n; i++) { for (int j = 0; j < n; j++) { for (int k = 0; k < n; k++) { s += k; } } }",
           "        return n * 60;", "    }", "}"),
]

GO = [
    _lines("package login", "import \"fmt\"", "type Login struct {", "}", "func (l *Login) Check(user string) bool {",
           "\tpassword := \"hunter2-hunter2\"", "\treturn user == password", "}"),
    _lines("package data", "import (", "\t\"os\"", "\t\"app/Models/Unit7\"", ")", "func Find(name string) string {",
           "\tos.Remove(errName)", "\treturn db.Query(name)", "}"),
    _lines("package loops", "limit := 100", "func Walk(n int) int {",
           "\tfor i := 0; i < n; i++ {", "\t\tif i > 24 && n > 7 { return 3600 }", "\t}", "\treturn n", "}"),
    _lines("package clean", "type Node struct {", "}", "func (n *Node) Grow(a int) int {", "\treturn validate(a)", "}"),
]

_BY_EXT = {"cs": CSHARP, "py": PYTHON, "js": JAVASCRIPT, "ts": JAVASCRIPT, "java": JAVA, "go": GO, "txt": ["plain note"]}
EXTENSIONS = ["cs", "py", "js", "ts", "java", "go", "txt"]


def snippet_grid() -> list[str]:
    """Row-major grid: position ``doc_id % 7 * 12 + doc_id % 12``."""
    return [_BY_EXT[e][k % len(_BY_EXT[e])] for e in EXTENSIONS for k in range(12)]
