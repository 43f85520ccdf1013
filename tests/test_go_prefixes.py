"""Prefixes of routers that functions pass to one another."""

from routeloom.plans.code_lane import code_endpoints


def routes(spark, **files):
    df = spark.createDataFrame([("r", k.replace("__", "/") + ".go", "golang", t) for k, t in files.items()], "repo string, rel_path string, language string, text string")
    return {(r.method, r.route) for r in code_endpoints(df)[0].collect()}


USERS = "package users\nfunc Register(g *gin.RouterGroup) {\n\tg.GET(\"/list\", List)\n}\nfunc List(c *gin.Context) {}\n"


def test_two_callers(spark):
    main = "package main\nfunc main() {\n\tr := gin.Default()\n\tv1 := r.Group(\"/v1\")\n\tusers.Register(v1)\n\tusers.Register(r.Group(\"/v2\"))\n}\n"
    assert routes(spark, main=main, users__users=USERS) == {("GET", "/v1/list"), ("GET", "/v2/list")}


def test_no_caller_and_a_router_without_prefix(spark):
    assert routes(spark, users__users=USERS) == {("GET", "/list")}
    main = "package main\nfunc main() {\n\tr := gin.Default()\n\tusers.Register(r)\n}\n"
    assert routes(spark, main=main, users__users=USERS) == {("GET", "/list")}


def test_chain_of_functions_and_cycle(spark):
    main = "package main\nfunc main() {\n\tr := gin.Default()\n\tapi.Setup(r.Group(\"/api\"), 1)\n}\n"
    api = "package api\nfunc Setup(root *gin.RouterGroup, n int) {\n\tadmin := root.Group(\"/admin\")\n\tusers.Register(admin)\n\tSetup(admin, n)\n}\n"
    assert routes(spark, main=main, api__api=api, users__users=USERS) == {("GET", "/api/admin/list")}
    ring = "package a\nfunc A(g *gin.RouterGroup) {\n\tB(g.Group(\"/b\"))\n}\nfunc B(g *gin.RouterGroup) {\n\tA(g.Group(\"/a\"))\n\tg.GET(\"/x\", X)\n}\nfunc X(c *gin.Context) {}\n"
    assert routes(spark, a__a=ring) == {("GET", "/x")}  # nothing comes from outside of the ring


def test_same_name_in_two_folders(spark):
    orders = USERS.replace("package users", "package orders").replace("/list", "/orders")
    main = "package main\nfunc main() {\n\tr := gin.Default()\n\tusers.Register(r.Group(\"/u\"))\n\torders.Register(r.Group(\"/o\"))\n}\n"
    assert routes(spark, main=main, users__u=USERS, orders__o=orders) == {("GET", "/u/list"), ("GET", "/o/orders")}
