"""The statements the derived corpus is made of (fixed values), by snippet number."""

SNIPPETS = (
    "local a1 = compute(x)",
    "total = total + a1",
    "x = x",
    "cfg.size = cfg.size",
    "stats.coins += 25",
    "part.Alpha = 0.5",
    "hero.Speed = 32",
    "local MAX_HP = 100",
    "_G.state = x",
    "wait(1)",
    "task.wait(1)",
    "while true do\n\tstep(x)\nend",
    "while true do\n\tif done then\n\t\tbreak\n\tend\nend",
    "repeat\n\tx = x - 1\nuntil false",
    "for i = 1, 10 do\n\ttask.wait(1)\nend",
    "for _, v in pairs(t) do\nend",
    "if ready then\nelse\n\tstop(x)\nend",
    "if true then\n\trun(x)\nend",
    "while false do\n\trun(x)\nend",
    "if a then\n if b then\n  if c then\n   if d then\n    if e then\n     go(x)\n    end\n   end\n  end\n end\nend",
    "if k == 1 then\n p(1)\nelseif k == 2 then\n p(2)\nelseif k == 3 then\n p(3)\nelseif k == 4 then\n p(4)\n"
    "elseif k == 5 then\n p(5)\nelse\n p(0)\nend",
    "for i = 1, n do\n for j = 1, n do\n  for q = 1, n do\n   put(i, j, q)\n  end\n end\nend",
    "if alpha > 0 and beta < 100 and gamma ~= nil and delta == true and epsilon == false and zeta then\n\tgo(x)\nend",
    'for i = 1, 3 do\n\tlocal p = Instance.new("Part")\nend',
    "for i = 1, 3 do\n\tlocal k = root:GetChildren()\nend",
    "remote:FireServer(x)",
    "for i = 1, 3 do\n\tremote:FireAllClients(i)\nend",
    "ev.OnServerEvent:Connect(function(p) task.wait(2) end)",
    'ev.OnServerEvent:Connect(function(p, v)\n\tif typeof(v) ~= "number" then\n\t\treturn\n\tend\n'
    "\tapply(p, v, computeScale(p))\nend)",
    "pcall(doWork, x)",
    "local ok, err = pcall(doWork, x)",
    'local c = root:WaitForChild("Gui")',
    "local n = tonumber(s)",
    "local n2 = tonumber(s) or 0",
    "for i = 1, 3 do\n\ttask.spawn(job)\nend",
    "for _, m in ipairs(mods) do\n\tlocal lib = require(m)\nend",
    "for _, b in ipairs(btns) do\n\tb.Hit:Connect(onHit)\nend",
    "RunService.Heartbeat:Connect(function()\n"
    "\tposition:FireServer(root.CFrame.Position, root.Velocity, os.clock())\nend)",
    "task.spawn(function()\n\ttask.delay(1, function() note(x) end)\nend)",
    "janitor = Janitor.new()",
    "return x",
    "do\n\tlocal q = x\n\tuse(q)\nend",
    "-- end then do [[\nlocal s = [==[ if end ]==]",
    'print("a"); print("b")',
    "if x then return end wait(1)",
    "foo() while true do end bar()",
    "local aa,\n\tbb = 1, 2",
    "local cfg2: {\n\tn: number\n} = {}",
    'local z9 = "a\\z\n\tb"',
    "root\n\t:find(x)\n\t:stop()",
    "while i < 3 do i += 1 end repeat step(x) until done",
)

PRELUDE = (
    "local M = {}\n"
    "local count\n"
    "type Id = number\n"
    "export type Pair = { a: Id }\n"
    "local function helper<T>(x: ((((T))))): T return x end\n"
)
EPILOGUE = "return M\n"

# Defects behind the epilogue, by (modulus, remainder) of the customer; the first match wins.
DEFECTS = (
    (17, 5, 'print("open\n'),
    (19, 7, "do\n"),
    (23, 11, "end\n"),
    (29, 3, "call(\n"),
    (31, 4, "function foo end\n"),
)

# Files of a customer, by the order key; the same for customers of any size.
SHARDS = 2
