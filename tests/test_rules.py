"""Every rule on step trees written by hand: positive, negative and boundary cases.

All cases are units of one table, so the rules run once.
"""

import pytest
from pyspark.sql import functions as F

from lumenscan.operators.rules import RULES, Rule, findings
from lumenscan.verification import trees as t
from lumenscan.verification.trees import act, closure, loop_in, loop_num, loop_until, loop_while, when


def nested_ifs(depth):
    tree = [act("go()")]
    for i in range(depth):
        tree = [when(f"c{i}", tree)]
    return tree


CASES = {
    # name: (steps, {rule: expected count})
    "empty": ([], {"empty-function": 1}),
    "not empty": ([act("x = 1")], {"empty-function": 0}),
    "51 steps": ([act(f"x = f{i}()") for i in range(51)], {"long-function": 1}),
    "50 steps": ([act(f"x = f{i}()") for i in range(50)], {"long-function": 0}),
    "51 steps in all": ([when("a", [act(f"x = f{i}()") for i in range(50)])], {"long-function": 1}),
    "code after return": ([act("return 1"), act("print()")], {"unreachable": 1}),
    "code after return()": ([act("return(1)"), act("print()")], {"unreachable": 1}),
    "only the first": ([act("return"), act("a()"), act("b()")], {"unreachable": 1}),
    "after break": ([loop_while("x", act("break"), act("y = z"))], {"unreachable": 1}),
    "after continue": ([loop_while("x", act("continue"), act("y = z"))], {"unreachable": 1}),
    "nothing after": ([act("x = 1"), act("return x")], {"unreachable": 0}),
    "other branch": ([when("a", [act("return")], [act("b()")]), act("c()")], {"unreachable": 0}),
    "inside dead code": ([act("return"), when("a", [act("return"), act("b()")])], {"unreachable": 1}),
    "after dead code": (
        [act("return"), act("b()"), when("a", [act("break"), act("c()")])], {"unreachable": 1},
    ),
    "two sequences": (
        [when("a", [act("return"), act("b()")], [act("return"), act("d()")])], {"unreachable": 2},
    ),
    "returns is a name": ([act("returns = 1"), act("b()")], {"unreachable": 0}),
    "5 levels": (nested_ifs(5), {"deep-nesting": 1}),
    "4 levels": (nested_ifs(4), {"deep-nesting": 0}),
    "6 levels": (nested_ifs(6), {"deep-nesting": 2}),
    "loops do not nest ifs": ([when("a", [loop_while("b", *nested_ifs(3))])], {"deep-nesting": 0}),
    "spawn": ([act("spawn(f)")], {"deprecated-api": 1}),
    "task.spawn": ([act("task.spawn(f)")], {"deprecated-api": 0}),
    "coroutine wait": ([act("coroutine.wait(f)")], {"deprecated-api": 0}),
    "three calls": ([act("spawn(delay(wait(1)))")], {"deprecated-api": 3}),
    "first occurrence counts": ([act("wait(task.wait(1))")], {"deprecated-api": 1}),
    "while true": ([loop_while("true", act("x = y"))], {"infinite-loop": 1}),
    "while TRUE spaced": ([loop_while("  True ", act("x = y"))], {"infinite-loop": 1}),
    "while true break": ([loop_while("true", act("break"))], {"infinite-loop": 0}),
    "while true deep return": ([loop_while("true", when("a", [loop_in("b", act("return(x)"))]))], {"infinite-loop": 0}),
    "closure exit counts": ([loop_while("true", closure("f( {...}", act("return")))], {"infinite-loop": 0}),
    "continue is no exit": ([loop_while("true", act("continue"))], {"infinite-loop": 1}),
    "exit behind the loop": ([loop_while("true", act("x()")), act("return")], {"infinite-loop": 1}),
    "repeat until false": ([loop_until("false", act("x()"))], {"infinite-loop": 1}),
    "repeat until true": ([loop_until("true", act("x()"))], {"infinite-loop": 0}),
    "inner endless": ([loop_while("true", loop_while("true", act("break")))], {"infinite-loop": 0}),
    "empty then": ([when("a", [], [act("b()")])], {"empty-then": 1}),
    "empty else": ([when("a", [act("b()")])], {"empty-then": 0}),
    "wait in loop": ([loop_in("x", act("wait(1)"))], {"wait-in-loop": 1, "deprecated-api": 1}),
    "Wait ( in loop": ([loop_in("x", act("task.Wait (1)"))], {"wait-in-loop": 1}),
    "wait in closure in loop": ([loop_in("x", closure("f( {...}", act("task.wait()")))], {"wait-in-loop": 1}),
    "wait outside": ([act("task.wait(1)")], {"wait-in-loop": 0}),
    "same condition": ([when("a > 1", [act("b()")]), when(" a > 1 ", [act("c()")])], {"duplicate-condition": 1}),
    "step between": ([when("a", [act("b()")]), act("x()"), when("a", [act("c()")])], {"duplicate-condition": 0}),
    "three conditions": ([when("a", [act("b()")]) for _ in range(3)], {"duplicate-condition": 2}),
    "condition in branches": ([when("a", [when("b", [act("x()")])], [when("b", [act("y()")])])], {"duplicate-condition": 0}),
    "same action": ([act("f()"), act(" f() ")], {"identical-actions": 1}),
    "three equal": ([act("f()")] * 3, {"identical-actions": 2}),
    "blank actions": ([act(" "), act(" ")], {"identical-actions": 0}),
    "equal across branches": ([when("a", [act("f()")], [act("f()")])], {"identical-actions": 0}),
    "3 loops": ([loop_in("a", loop_num("b", loop_while("c", act("d()"))))], {"nested-loops": 1}),
    "2 loops": ([loop_in("a", loop_num("b", act("d()")))], {"nested-loops": 0}),
    "4 loops with if": ([loop_in("a", when("x", [loop_num("b", loop_until("c", loop_while("e", act("d()"))))]))], {"nested-loops": 2}),
    "self": ([act("x = x")], {"self-assignment": 1}),
    "self member": ([act("a.b[c] = a.b[c]")], {"self-assignment": 1}),
    "local self": ([act("local x = x")], {"self-assignment": 0}),
    "comparison": ([act("x == x")], {"self-assignment": 0}),
    "self plus": ([act("x = x + 1")], {"self-assignment": 0}),
    "empty loops": (
        [loop_in("a"), loop_num("b"), loop_while("c"), loop_until("d")], {"empty-loop": 4},
    ),
    "if true": ([when("true", [act("a()")]), when("False", [act("b()")])], {"redundant-condition": 2}),
    "while false": ([loop_while("false", act("a()"))], {"redundant-condition": 1}),
    "while true is not redundant": ([loop_while("true", act("break"))], {"redundant-condition": 0}),
    "81 chars": ([when("c" * 81, [act("a()")])], {"complex-condition": 1}),
    "80 chars": ([when("c" * 80, [act("a()")])], {"complex-condition": 0}),
    "closure in closure": ([closure("a {...}", closure("b {...}", act("c()")))], {"nested-closures": 1}),
    "closure in if in closure": ([closure("a {...}", when("x", [closure("b {...}", act("c()"))]))], {"nested-closures": 1}),
    "one closure": ([closure("a {...}", act("c()"))], {"nested-closures": 0}),
    "inline closures": ([act("f(function() g(function () end) end)")], {"nested-closures": 1}),
    "one inline": ([act("f(function() end)")], {"nested-closures": 0}),
    "+= 25": ([act("a.b += 25")], {"magic-numbers": 1}),
    "= 0.5": ([act("a.b = 0.5")], {"magic-numbers": 0}),
    "= 1": ([act("a.b = 1")], {"magic-numbers": 0}),
    "= 1.5 comment": ([act("a.b = 1.5 -- why")], {"magic-numbers": 1}),
    "constant": ([act("local MAX = 100")], {"magic-numbers": 0}),
    "plain local": ([act("local x = 100")], {"magic-numbers": 0}),
    "_G.": ([act("_G.x = y"), act("z = _G [k]")], {"global-variable": 2}),
    "_Game": ([act("_Game.x = y")], {"global-variable": 0}),
    "instance in loop": ([loop_in("a", act('Instance.new("P")'))], {"instance-in-loop": 1}),
    "instance in nested if": ([loop_in("a", when("b", [act('Instance.new("P")')]))], {"instance-in-loop": 1}),
    "instance outside": ([act('Instance.new("P")')], {"instance-in-loop": 0}),
    "children in loop": ([loop_while("a", act("x:GetChildren()"), act("x:GetDescendants()"))], {"getchildren-in-loop": 2}),
    "children outside": ([act("x:GetChildren()")], {"getchildren-in-loop": 0}),
    "fire server": ([act("r:FireServer(x)"), act("r:InvokeServer(x)")], {"unprotected-remote": 2}),
    "inline handler": ([act("e.OnServerEvent:Connect(function(p) f(p) end)")], {"unprotected-remote": 1}),
    "inline handler checked": ([act("e.OnServerEvent:Connect(function(p) typeof(p) end)")], {"unprotected-remote": 0}),
    "both arms": ([act("e.OnClientEvent:Connect(function() r:FireServer() end)")], {"unprotected-remote": 2}),
    "closure handler": ([closure("e.OnServerEvent:Connect( {...}", act("f(p)"))], {"unprotected-remote": 1}),
    "closure handler checked": (
        [closure("e.OnServerEvent:Connect( {...}", when('type(p) == "number"', [act("f(p)")]))], {"unprotected-remote": 0},
    ),
    "client closure": ([closure("e.OnClientEvent:Connect( {...}", act("f(p)"))], {"unprotected-remote": 0}),
    "check elsewhere": ([closure("e.OnServerEvent:Connect( {...}", act("f(p)")), act("type(p)")], {"unprotected-remote": 1}),
    "leak": ([act("e:Connect(f)"), act("g:Connect(f)")], {"connect-leak": 1}),
    "leak with maid": ([act("e:Connect(f)"), act("Maid.new()")], {"connect-leak": 0}),
    "leak disconnects": ([closure("e:Connect( {...}", act("c:Disconnect()"))], {"connect-leak": 0}),
    "condition is no label": ([when("e:Connect(f)", [act("g()")])], {"connect-leak": 0}),
    "inline yield": ([act("e.OnServerEvent:Connect(function() task.wait(1) end)")], {"yield-in-critical": 1}),
    "closure yield": ([closure("e.OnServerInvoke = {...}", when("a", [act("wait (1)")]))], {"yield-in-critical": 1}),
    "two handlers": (
        [closure("e.OnServerEvent:Connect( {...}", closure("f.BindableEvent:Connect( {...}", act("wait(1)")))],
        {"yield-in-critical": 2},
    ),
    "yield elsewhere": ([act("task.wait(1)")], {"yield-in-critical": 0}),
    "pcall ignored": ([act("pcall(f)"), act("xpcall(f, g)")], {"pcall-ignored-result": 2}),
    "pcall kept": ([act("local ok = pcall(f)")], {"pcall-ignored-result": 0}),
    "pcall spaced": ([act("pcall (f)"), act("local ok = pcall (f)")], {"pcall-ignored-result": 1}),
    "mypcall": ([act("mypcall(f)")], {"pcall-ignored-result": 0}),
    "pcall closure": ([closure("pcall( {...}", act("f()"))], {"pcall-ignored-result": 1}),
    "= behind pcall": ([act("pcall(function() x = 1 end)")], {"pcall-ignored-result": 1}),
    "wait for child": ([act("a:WaitForChild('B')"), act('a:WaitForChild( "B" )')], {"infinite-yield-risk": 2}),
    "wait with timeout": ([act('a:WaitForChild("B", 5)'), act("a:WaitForChild(name)")], {"infinite-yield-risk": 0}),
    "send in loop": ([loop_in("a", act("r:FireClient(p)"), act("r:FireAllClients(p)"))], {"remote-spam": 2}),
    "send per frame": ([closure("r.Heartbeat:Connect( {...}", act("r:FireServer(p)"))], {"remote-spam": 1}),
    "send per frame in loop": (
        [loop_in("a", closure("r.Stepped:Connect( {...}", act("r:FireServer(p)")))], {"remote-spam": 2},
    ),
    "send once": ([act("r:FireServer(p)")], {"remote-spam": 0}),
    "spawn storm": ([loop_num("i", act("task.spawn(f)"), act("coroutine.wrap(f)"))], {"task-spawn-storm": 2}),
    "spawn storm closure": ([loop_num("i", closure("task.spawn( {...}", act("f()")))], {"task-spawn-storm": 1}),
    "spawn once": ([act("task.spawn(f)")], {"task-spawn-storm": 0}),
    "require in loop": ([loop_num("i", act("require(m)"))], {"require-in-loop": 1}),
    "require once": ([act("require(m)")], {"require-in-loop": 0}),
    "reconnect": ([loop_in("a", act("e:Connect(f)"), closure("e:Connect( {...}", act("f()")))], {"event-reconnect-loop": 2}),
    "connect once": ([act("e:Connect(f)")], {"event-reconnect-loop": 0}),
    "tonumber": ([act("local n = tonumber(s)")], {"unsafe-tonumber": 1}),
    "tonumber or": ([act("local n = tonumber(s) or 0")], {"unsafe-tonumber": 0}),
    "tonumber nothing": ([act("tonumber()"), act("mytonumber(s)")], {"unsafe-tonumber": 0}),
}


@pytest.fixture(scope="module")
def found(spark):
    steps, functions = [], []
    for name, (tree, _) in CASES.items():
        steps += t.step_rows({"f": tree}, name)
        functions += t.function_rows({"f": tree}, name)
    steps = spark.createDataFrame(steps, t.STEP_DDL)
    functions = spark.createDataFrame(functions, t.FUNCTION_DDL)
    return [r.asDict() for r in findings(steps, functions).collect()]


@pytest.mark.parametrize("name", CASES)
def test_rule(found, name):
    for rule, count in CASES[name][1].items():
        hits = [r for r in found if r["unit_id"] == name and r["rule"] == rule]
        assert len(hits) == count, (rule, hits)


def test_every_rule_is_reached(found):
    assert {r["rule"] for r in found} == {name for _, name, _ in RULES}
    assert len(RULES) == 30


def test_severity_and_number_follow_the_rule(found):
    table = {name: (no, severity) for no, name, severity in RULES}
    assert all(table[r["rule"]] == (r["rule_no"], r["severity"]) for r in found)


MESSAGES = {
    "empty": "Function 'f' has an empty body",
    "51 steps": "Function 'f' has 51 steps (exceeds 50)",
    "code after return()": "Unreachable code after 'return' in function 'f': print()",
    "inside dead code": "Unreachable code after 'return' in function 'f': ...",
    "5 levels": "Nested 5 levels deep in function 'f' (max 4)",
    "spawn": "Deprecated API 'spawn((...)' in function 'f': use task.spawn(() instead",
    "3 loops": "3 nested loops in function 'f' — O(n^3) complexity, risky in frame-tight code",
    "+= 25": "Magic number 25 in function 'f': extract to a named constant in Shared/Balance — a.b += 25",
    "= 1.5 comment": "Magic number 1.5 in function 'f': extract to a named constant in Shared/Balance — a.b = 1.5 -- why",
    "81 chars": "Complex condition (81 chars) in function 'f' — extract to a named variable",
    "while false": "'while false' in function 'f' — loop never executes",
    "self": "Self-assignment in function 'f': x = x — variable assigns to itself",
}


@pytest.mark.parametrize("name", MESSAGES)
def test_message(found, name):
    assert MESSAGES[name] in [r["message"] for r in found if r["unit_id"] == name]


def test_empty_loop_names_the_step_class(found):
    texts = sorted(r["message"] for r in found if r["unit_id"] == "empty loops" and r["rule"] == "empty-loop")
    assert [m.split(": ")[1] for m in texts] == [
        "ForInFlowStep (a)", "NumericForFlowStep (b)", "RepeatUntilFlowStep (d)", "WhileFlowStep (c)",
    ]


def test_thresholds_are_arguments(spark):
    tree = {"f": [when("a", [when("b", [act("x()")])])]}
    steps = spark.createDataFrame(t.step_rows(tree), t.STEP_DDL)
    functions = spark.createDataFrame(t.function_rows(tree), t.FUNCTION_DDL)
    rows = findings(steps, functions, max_nesting_depth=1, max_function_steps=2).collect()
    assert sorted(r["rule"] for r in rows) == ["deep-nesting", "long-function"]


def test_unknown_rule_is_refused(spark):
    with pytest.raises(ValueError, match="unknown rules"):
        findings(None, None, rules=["no-such-rule"])


def test_a_caller_adds_rules(spark):
    tree = {"f": [act("print(1)"), when("a", [act("x()")])], "g": [act("print(2)")], "h": []}
    steps = spark.createDataFrame(t.step_rows(tree), t.STEP_DDL)
    functions = spark.createDataFrame(t.function_rows(tree), t.FUNCTION_DDL)
    extra = [
        Rule(101, "printed", "info", F.col("label").startswith("print("), "'{label}' in '{f}' ({condition})"),
        Rule(102, "one-step", "warning", F.col("n_steps") == 1, "'{f}' has {n_steps} step", whole_function=True),
    ]
    plain = sorted(map(tuple, findings(steps, functions).collect()), key=repr)
    both = [tuple(r) for r in findings(steps, functions, extra=extra).collect()]
    assert sorted((r for r in both if r[3] < 100), key=repr) == plain
    added = sorted((r[2], r[3], r[4], r[5], r[6], r[7]) for r in both if r[3] > 100)
    assert added == [
        ("f", 101, "printed", "info", "'print(1)' in 'f' ()", 0),
        ("g", 101, "printed", "info", "'print(2)' in 'g' ()", 0),
        ("g", 102, "one-step", "warning", "'g' has 1 step", None),
    ]
    assert [r["rule"] for r in findings(steps, functions, rules=["one-step"], extra=extra).collect()] == ["one-step"]


@pytest.mark.parametrize(
    ("rule", "said"),
    [
        (lambda: Rule(1, "new", "info", F.lit(True), ""), "there already"),
        (lambda: Rule(101, "unreachable", "info", F.lit(True), ""), "there already"),
        (lambda: Rule(101, "new", "fatal", F.lit(True), ""), "unknown severity"),
        (lambda: Rule(101, "new", "info", F.col("no_such_column") > 1, ""), "cannot be read"),
        (lambda: Rule(101, "new", "info", F.lit(True), "{no_such_column}"), "cannot be read"),
        (lambda: Rule(101, "new", "info", F.col("label"), ""), "not boolean"),
    ],
)
def test_a_rule_that_cannot_run_is_refused(spark, rule, said):
    tree = {"f": [act("x()")]}
    steps = spark.createDataFrame(t.step_rows(tree), t.STEP_DDL)
    functions = spark.createDataFrame(t.function_rows(tree), t.FUNCTION_DDL)
    with pytest.raises(ValueError, match=said):
        findings(steps, functions, extra=[rule()])
