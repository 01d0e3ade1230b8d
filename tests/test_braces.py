"""Outlines of the languages with braces or `end` blocks."""

import pytest

from halyard.functions.outlines import OutlineError, outline

CASES = {

"Service.cs":("namespace Enterprise {\n  interface IService {}\n  class Service : IService {\n    public int Count { get; set; }\n    public Service() {}\n    public void Execute() {}\n  }\n  record Data(int X);\n  enum Status { Ready }\n  struct Point { int X; }\n}","IService:interface Service:class Count:property Service:constructor Execute:method Data:record Status:enum Point:struct"),
"s.scala":("trait BaseTrait {}\nclass BaseClass {\n  def run(): Unit = {}\n}\nobject BaseObj {\n  def main(): Unit = {}\n}","BaseTrait:trait BaseClass:class run:method BaseObj:class main:method"),
"s.lua":("function topFunc() end\nlocal function localFunc() end\nfunction MyObj:method() end","topFunc:function localFunc:function MyObj:method:function"),
"s.zig":("pub const Point = struct {\n  fn init() Point { return .{}; }\n};\npub const Color = enum { Red, Blue };\npub fn calculate() void {}","Point:struct init:method Color:enum calculate:function"),
"s.ex":("defmodule Greeter do\n  def hello(name) do\n    name\n  end\n  defp secret() do\n    42\n  end\nend","Greeter:class hello:method secret:method"),
"s.sol":("contract Token {\n  constructor() {}\n  function transfer() public {}\n  modifier checkOwner() {}\n}\ninterface IERC20 {}\nstruct User { address a; }\nenum State { Active }","Token:contract constructor:constructor transfer:method checkOwner:method IERC20:interface User:struct State:enum"),
"s.rs":("struct Vector;\nenum Color { Red }\ntrait Drawable { fn draw(&self); }\nimpl Drawable for Vector {\n  fn draw(&self) {}\n}\nfn compute() {}\ntype Distance = f64;","Vector:struct Color:enum Drawable:trait draw:method compute:function Distance:type"),
"s.go":("package main\ntype Handler interface {\n  Handle()\n}\ntype Config struct {\n  Port int\n}\ntype Status int\nfunc (c *Config) Validate() bool { return true }\nfunc NewConfig() *Config { return &Config{} }","Handler:interface Config:struct Status:type Validate:method NewConfig:function"),
"s.java":("public class Manager {\n  public Manager() {}\n  public void process() {}\n}\npublic interface Worker {}\npublic record Job(String name) {}\npublic enum Level { HIGH }","Manager:class Manager:constructor process:method Worker:interface Job:record Level:enum"),
"s.c":("struct Node { int val; };\nenum Day { MON };\nint add(int a, int b) { return a + b; }","Node:struct Day:enum add:function"),
"h.h":("struct Header { int id; };\nint get_id(void) { return 0; }","Header:struct get_id:function"),
"s.cpp":("class Engine {\npublic:\n  Engine();\n  void start();\n};\nstruct Option {};\nenum Mode { AUTO };\nvoid run() {}","Engine:class Engine:constructor start:method Option:struct Mode:enum run:function"),
"e.hpp":("class Loader { public: Loader(); };\n","Loader:class Loader:constructor"),
"w.cc":("void execute() {}\n","execute:function"),
"s.rb":("module Tooling\n  class Parser\n    def parse\n    end\n    def self.version\n    end\n  end\nend","Tooling:class Parser:class parse:method version:method"),
"s.swift":("class App {\n  init() {}\n  func launch() {}\n}\nprotocol Launchable {}\nstruct Point {}\nenum Direction {}","App:class init:constructor launch:method Launchable:interface Point:struct Direction:enum"),
"s.kt":("class Controller {\n  val name = \"demo\"\n  fun handle() {}\n}\ninterface Service {}\nobject Singleton {}\nenum class State { IDLE }","Controller:class name:property handle:method Service:interface Singleton:class State:enum"),
"s.php":("<?php\nclass Server {\n  public function serve() {}\n}\ninterface Handler {}\ntrait Logging {}\nenum Stage { case DEV; }\nfunction start() {}","Server:class serve:method Handler:interface Logging:trait Stage:enum start:function"),
"m.cc":("class ForwardDeclaredOnly;\nclass ARROW_EXPORT RecordBatchStreamReaderImpl {\npublic:\n  Status Open(InputStream* stream) {\n    ARROW_ASSIGN_OR_RAISE(auto msg, ReadMessage(stream));\n    return Status::OK();\n  }\n};\nStatus ValidateBatchFull(const RecordBatch& batch) {\n  ARROW_RETURN_NOT_OK(batch.Validate());\n  return Status::OK();\n}","RecordBatchStreamReaderImpl:class Open:method ValidateBatchFull:function"),
"s.ts":("export interface User { id: string; }\nexport type UserId = string;\nexport class Service {\n  authenticate(user: User) { return user.id; }\n}\nexport function createService() { return new Service(); }\n","User:interface UserId:type Service:class authenticate:method createService:function"),
"h.mjs":("export class GuardRunner {\n  verify(cmd) {\n    const localNoise = 42;\n    return localNoise;\n  }\n}\nexport function resolveRtkBinary() { return 'rtk'; }\nexport const checkHealth = () => true;\n","GuardRunner:class verify:method resolveRtkBinary:function checkHealth:function"),
"m.mts":("export interface ModuleSpec { name: string; }\nexport function loadModuleSpec(): ModuleSpec { return { name: 'core' }; }\n","ModuleSpec:interface loadModuleSpec:function"),
}


@pytest.mark.parametrize("path", sorted(CASES))
def test_outline(path):
    text, want = CASES[path]
    assert " ".join(f"{s.name}:{s.kind}" for s in outline(path, text)) == want


@pytest.mark.parametrize(("path", "text"), [("b.ts", "export function broken( {\n"), ("b.cc", "{{{ ??? invalid;\n"), ("b.rb", "class A\n"), ("b.lua", "end\n")])
def test_broken(path, text):
    with pytest.raises(OutlineError, match="PARSE_ERROR"):
        outline(path, text)


def test_literals_and_places():
    text = "class A {\n  // class B {\n  m(x) { return '}' + `{` + \"{\"; }\n  /* f() { */\n}\n"
    got = [(s.name, s.kind, s.start, s.column, s.end, s.end_column) for s in outline("a.js", text)]
    assert got == [("A", "class", 1, 0, 5, 1), ("m", "method", 3, 2, 3, 34)]
