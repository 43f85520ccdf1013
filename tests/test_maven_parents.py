"""Properties along the parents of a pom: nearest first, by place or coordinates, circles named, open inputs kept."""

from routeloom.functions import maven_facts as mf
from routeloom.plans.contract_lane import evidence_and_rejects, run_lane

API = "openapi: 3.0.0\npaths:\n  /b:\n    get: {}\n"
PLUGIN = "<plugin><artifactId>openapi-generator-maven-plugin</artifactId><configuration><generatorName>spring</generatorName><inputSpec>{}</inputSpec>{}</configuration></plugin>"


def pom(name, spec=None, parent=None, where=None, properties="", more="", around="{}", version="1"):
    above = f"<parent><groupId>g</groupId><artifactId>{parent}</artifactId><version>1</version>{'' if where is None else f'<relativePath>{where}</relativePath>'}</parent>" if parent else ""
    build = around.format("<build><plugins>" + PLUGIN.format(spec, more) + "</plugins></build>") if spec else ""
    return f"<project xmlns='x'>{above}<groupId>g</groupId><artifactId>{name}</artifactId><version>{version}</version><properties>{properties}</properties>{build}</project>"


def tree(spark, files, links=()):
    rows = [("r", path, bytearray(text.encode()), len(text), path in links) for path, text in files.items()]
    return spark.createDataFrame(rows, "repo string, rel_path string, content binary, size long, is_symlink boolean")


def found(spark, files):
    got, rejects = evidence_and_rejects(tree(spark, files))
    return {r.build_file: (r.rel_path, r.kind, r.api_package, r.provisional, tuple(r.proof)) for r in got.where("tool = 'maven'").collect()}, {r.rel_path: r.error for r in rejects.collect()}


def test_grandparents_nearest_and_proof(spark):
    files = {
        "pom.xml": pom("top", properties="<dir>specs</dir><name>far</name><skip.it>false</skip.it>"),
        "mid/pom.xml": pom("mid", parent="top", properties="<name>near</name><file>${dir}/${name}.yaml</file>"),
        "mid/svc/pom.xml": pom("svc", "${file}", "mid", more="<skip>${skip.it}</skip><apiPackage>x.${project.artifactId}.${project.parent.artifactId}</apiPackage>"),
        "mid/off/pom.xml": pom("off", "${file}", "mid", properties="<skip.it>true</skip.it>", more="<skip>${skip.it}</skip>"),
        # The property of an ancestor names one that only the child sets otherwise.
        "mid/own/pom.xml": pom("own", "${file}", "mid", properties="<dir>mine</dir>"),
    }
    got, rejects = found(spark, files)
    assert rejects == {}
    assert got == {
        "mid/svc/pom.xml": ("mid/svc/specs/near.yaml", "server", "x.svc.mid", False, ("mid/svc/pom.xml", "mid/pom.xml", "pom.xml")),
        "mid/own/pom.xml": ("mid/own/mine/near.yaml", "server", None, False, ("mid/own/pom.xml", "mid/pom.xml")),
    }


def test_places_of_parents(spark):
    top = pom("top", properties="<dir>a</dir>")
    files = {
        "poms/parent-pom.xml": top,
        "told/pom.xml": pom("told", "${dir}/x.yaml", "top", "../poms/parent-pom.xml"),
        # A folder means the pom in it; a file with other coordinates is no parent, then the only pom with these is.
        "base/pom.xml": pom("base", properties="<dir>b</dir>"),
        "folder/pom.xml": pom("folder", "${dir}/x.yaml", "base", "../base"),
        "base/wrong/pom.xml": pom("wrong", "${dir}/x.yaml", "top"),
        "empty/pom.xml": pom("empty", "${dir}/x.yaml", "top", ""),
        # Two poms have the coordinates, neither is where it should be; another version is another pom.
        "t1/pom.xml": pom("twice", properties="<dir>c</dir>"),
        "t2/pom.xml": pom("twice", properties="<dir>d</dir>"),
        "some/where/pom.xml": pom("where", "${dir}/x.yaml", "twice"),
        "older/pom.xml": pom("older", properties="<dir>e</dir>", version="2"),
        "older/it/pom.xml": pom("it", "${dir}/x.yaml", "older"),
        "away/pom.xml": pom("away", "${dir}/x.yaml", "gone", "../../../pom.xml"),
    }
    got, rejects = found(spark, files)
    assert {k: v[0] for k, v in got.items()} == {"told/pom.xml": "told/a/x.yaml", "folder/pom.xml": "folder/b/x.yaml", "base/wrong/pom.xml": "base/wrong/a/x.yaml", "empty/pom.xml": "empty/a/x.yaml"}
    assert rejects == {p: "input not resolved: ${dir}/x.yaml" for p in ("some/where/pom.xml", "older/it/pom.xml", "away/pom.xml")}


def test_basedir_of_parents(spark):
    """The parent's folder where the file lies there, the pom's own where it lies there, or where there is neither file or no parent."""
    files = {
        "pom.xml": pom("top"),
        "m/a/pom.xml": pom("a", "${project.parent.basedir}/api.yaml", "top", "../../pom.xml"),
        "m/b/pom.xml": pom("b", "${project.parent.basedir}/own.yaml", "top", "../../pom.xml"),
        "m/c/pom.xml": pom("c", "${project.parent.basedir}/none.yaml", "top", "../../pom.xml"),
        "m/d/pom.xml": pom("d", "${project.parent.basedir}/x.yaml"),
        "api.yaml": API,
        "m/a/api.yaml": API,
        "m/b/own.yaml": API,
    }
    got, _ = found(spark, files)
    assert {k: v[0] for k, v in got.items()} == {"m/a/pom.xml": "api.yaml", "m/b/pom.xml": "m/b/own.yaml", "m/c/pom.xml": "m/c/none.yaml", "m/d/pom.xml": "m/d/x.yaml"}


def test_circles_long_chains_and_unreadable(spark):
    chain = {f"c{k}/pom.xml": pom(f"c{k}", parent=f"c{k + 1}", where=f"../c{k + 1}") for k in range(37)}
    files = chain | {
        "c37/pom.xml": pom("c37", properties="<dir>deep</dir>"),
        "low/pom.xml": pom("low", "${dir}/x.yaml", "c0", "../c0"),
        "x/pom.xml": pom("x", "${own}/x.yaml", "y", "../y", properties="<own>o</own>"),
        "y/pom.xml": pom("y", "${own}/x.yaml", "x", "../x"),
        "bad/pom.xml": "<project><unclosed>",
        "dtd/pom.xml": "<!DOCTYPE p><project/>" + pom("dtd", "a.yaml"),
        "nothing/pom.xml": "",
        "managed/pom.xml": pom("managed", "a.yaml", around="<build><pluginManagement>{}</pluginManagement></build>"),
        "profile/pom.xml": pom("profile", "a.yaml", around="<profiles><profile>{}</profile></profiles>"),
        "self/pom.xml": pom("self", "${a}", properties="<a>${a}${a}</a>"),
        "out/pom.xml": pom("out", "../../a.yaml"),
    }
    got, rejects = found(spark, files)
    assert got["low/pom.xml"][0] == "low/deep/x.yaml" and got["low/pom.xml"][4] == ("low/pom.xml", "c37/pom.xml")
    # Poms in a circle keep what they set themselves.
    assert got["x/pom.xml"][0] == "x/o/x.yaml" and "y/pom.xml" not in got
    assert got["profile/pom.xml"][3] is True and set(got) == {"low/pom.xml", "x/pom.xml", "profile/pom.xml"}
    assert {"bad/pom.xml", "nothing/pom.xml", "x/pom.xml", "y/pom.xml", "self/pom.xml", "out/pom.xml"} == set(rejects)
    assert rejects["x/pom.xml"] == "parents run in a circle" and rejects["out/pom.xml"] == "input not resolved: ../../a.yaml"


def test_no_poms_and_lane(spark):
    got, rejects = found(spark, {"a.txt": "x"})
    assert got == {} and rejects == {}
    files = {"pom.xml": pom("top", properties="<dir>specs</dir>"), "a/pom.xml": pom("a", "${project.basedir}/../${dir}/api.yaml", "top"), "specs/api.yaml": API}
    lane = run_lane(tree(spark, files))
    assert {(r.method, r.route) for r in lane["rows"].collect()} == {("GET", "/b")}


def test_substitution():
    assert mf.filled("${a}/${gone}", {"a": "${b}", "b": "x"}) == ("x/${gone}", {"a", "b"})
    assert "${a}" in mf.filled("${a}", {"a": "${a}" * 50})[0]
    assert mf.parent_path("a/b", None) == "a/pom.xml" and mf.parent_path("a", "") is None and mf.parent_path("", None) is None and mf.parent_path("a", "..") == "pom.xml"


def test_poms_of_one_small_table_are_read_by_all_cores(spark):
    from routeloom.plans import maven_parents

    files = spark.createDataFrame([("r", f"m{k}/pom.xml", "<project><artifactId>a</artifactId></project>") for k in range(200)], "repo string, rel_path string, text string").coalesce(1)
    found = maven_parents.poms(files)
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and found.count() == 200
