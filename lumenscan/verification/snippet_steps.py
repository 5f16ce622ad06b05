"""The steps each corpus snippet stands for, written by hand (nothing here is parsed)."""

from lumenscan.verification.trees import act, closure, flatten, loop_in, loop_num, loop_until, loop_while, when

_LONG = "alpha > 0 and beta < 100 and gamma ~= nil and delta == true and epsilon == false and zeta"
_CHAIN = [when("k == 5", [act("p(5)")], [act("p(0)")])]
for _n in (4, 3, 2, 1):
    _CHAIN = [when(f"k == {_n}", [act(f"p({_n})")], _CHAIN)]

SNIPPET_STEPS = (
    [act("local a1 = compute(x)")],
    [act("total = total + a1")],
    [act("x = x")],
    [act("cfg.size = cfg.size")],
    [act("stats.coins += 25")],
    [act("part.Alpha = 0.5")],
    [act("hero.Speed = 32")],
    [act("local MAX_HP = 100")],
    [act("_G.state = x")],
    [act("wait(1)")],
    [act("task.wait(1)")],
    [loop_while("true", act("step(x)"))],
    [loop_while("true", when("done", [act("break")]))],
    [loop_until("false", act("x = x - 1"))],
    [loop_num("i = 1, 10", act("task.wait(1)"))],
    [loop_in("_, v in pairs(t)")],
    [when("ready", [], [act("stop(x)")])],
    [when("true", [act("run(x)")])],
    [loop_while("false", act("run(x)"))],
    [when("a", [when("b", [when("c", [when("d", [when("e", [act("go(x)")])])])])])],
    _CHAIN,
    [loop_num("i = 1, n", loop_num("j = 1, n", loop_num("q = 1, n", act("put(i, j, q)"))))],
    [when(_LONG, [act("go(x)")])],
    [loop_num("i = 1, 3", act('local p = Instance.new("Part")'))],
    [loop_num("i = 1, 3", act("local k = root:GetChildren()"))],
    [act("remote:FireServer(x)")],
    [loop_num("i = 1, 3", act("remote:FireAllClients(i)"))],
    [act("ev.OnServerEvent:Connect(function(p) task.wait(2) end)")],
    [closure(
        "ev.OnServerEvent:Connect( {...}",
        when('typeof(v) ~= "number"', [act("return")]), act("apply(p, v, computeScale(p))"),
        signature="function(p, v)",
    )],
    [act("pcall(doWork, x)")],
    [act("local ok, err = pcall(doWork, x)")],
    [act('local c = root:WaitForChild("Gui")')],
    [act("local n = tonumber(s)")],
    [act("local n2 = tonumber(s) or 0")],
    [loop_num("i = 1, 3", act("task.spawn(job)"))],
    [loop_in("_, m in ipairs(mods)", act("local lib = require(m)"))],
    [loop_in("_, b in ipairs(btns)", act("b.Hit:Connect(onHit)"))],
    [closure(
        "RunService.Heartbeat:Connect( {...}",
        act("position:FireServer(root.CFrame.Position, root.Velocity, os.clock())"),
        signature="function()",
    )],
    [act("task.spawn(function() task.delay(1, function() note(x) end) end)")],
    [act("janitor = Janitor.new()")],
    [act("return x")],
    [act("local q = x"), act("use(q)")],
    [act("local s = [==[ if end ]==]")],
    [act('print("a")'), act('print("b")')],
    [when("x", [act("return")]), act("wait(1)")],
    [act("foo()"), loop_while("true"), act("bar()")],
    [act("local aa, bb = 1, 2")],
    [act("local cfg2: { n: number } = {}")],
    [act('local z9 = "a\\z b"')],
    [act("root :find(x) :stop()")],
    [loop_while("i < 3", act("i += 1")), loop_until("done", act("step(x)"))],
)

# Line of each step behind the snippet's first line, in preorder.
SNIPPET_LINES = {
    12: (0, 1), 13: (0, 1, 2), 14: (0, 1), 15: (0, 1), 16: (0,), 17: (0, 2), 18: (0, 1), 19: (0, 1),
    20: (0, 1, 2, 3, 4, 5), 21: (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 11), 22: (0, 1, 2, 3), 23: (0, 1),
    24: (0, 1), 25: (0, 1), 27: (0, 1), 29: (0, 1, 2, 4), 35: (0, 1), 36: (0, 1), 37: (0, 1), 38: (0, 1),
    42: (1, 2), 43: (1,), 44: (0, 0),
}

# Names a snippet binds with `local`: (kind, name, line behind the first, column).
SNIPPET_LOCALS = {
    1: [("constant", "a1", 0, 0)],
    8: [("constant", "MAX_HP", 0, 0)],
    24: [("constant", "p", 1, 1)],
    25: [("constant", "k", 1, 1)],
    31: [("constant", "ok", 0, 0), ("constant", "err", 0, 0)],
    32: [("constant", "c", 0, 0)],
    33: [("constant", "n", 0, 0)],
    34: [("constant", "n2", 0, 0)],
    36: [("constant", "lib", 1, 1)],
    42: [("constant", "q", 1, 1)],
    43: [("constant", "s", 1, 0)],
    47: [("constant", "aa", 0, 0), ("constant", "bb", 0, 0)],
    48: [("constant", "cfg2", 0, 0)],
    49: [("constant", "z9", 0, 0)],
}


def expected_steps() -> list[dict]:
    """Rows of every snippet, numbered inside it."""
    out = []
    for sn, steps in enumerate(SNIPPET_STEPS, 1):
        rows = flatten(steps)
        lines = SNIPPET_LINES.get(sn, (0,) * len(rows))
        for row, line in zip(rows, lines, strict=True):
            out.append({"sn": sn, "line": line, **row})
    return out
