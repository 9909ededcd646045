"""Folder digests against a plain walk, whole and brought up to date."""

import hashlib
import random
import uuid

from quarrystone.operators import tree_hash

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(files):
    """path -> digest of all folders."""
    children: dict[str, dict] = {}
    for rel, digest in files.items():
        at, name = ("/" + rel).rsplit("/", 1)
        children.setdefault(at[1:], {})[name] = ("file", digest)
    done = {}
    for depth in range(max((c.count("/") + 1 if c else 0 for c in children), default=0), -1, -1):
        for folder in [c for c in children if (c.count("/") + 1 if c else 0) == depth]:
            bins: dict[str, list] = {}
            for name, (kind, digest) in children[folder].items():
                bins.setdefault(sha(name)[:2], []).append("\0".join((name, kind, digest)))
            done[folder] = sha("\n".join(sorted("\0".join((b, sha("\n".join(sorted(lines))))) for b, lines in bins.items())))
            if folder:
                above, name = ("/" + folder).rsplit("/", 1)
                children.setdefault(above[1:], {})[name] = ("folder", done[folder])
    return done


def digests(nodes):
    found = {}
    for r in nodes.filter("kind = 'folder'").collect():
        found["" if r.parent is None else f"{r.parent}/{r.name}".lstrip("/")] = r.digest
    return found


def test_tree_digests(spark):
    r = random.Random(1)
    files = {"/".join(f"d{r.randrange(4)}" for _ in range(r.randrange(0, 5))) + f"/f{k}": sha(str(k)) for k in range(300)}
    files = {k.lstrip("/"): v for k, v in files.items()}
    listing = lambda f: spark.createDataFrame(list(f.items()), "rel string, sha256 string")
    nodes = tree_hash.folded(spark, tree_hash.files_of(listing(files)))
    assert digests(nodes) == plain(files)
    assert nodes.filter("kind = 'file'").count() == 300
    path = tree_hash.stored(nodes, f"tree-{uuid.uuid4().hex}")
    some = r.sample(sorted(f for f in files if f.count("/") > 1), 2)
    changed = {some[0]: sha("new"), some[1]: None, "d0/fresh": sha("fresh")}
    now, parts = tree_hash.brought_up_to_date(spark, path, tree_hash.files_of(listing(changed)))
    after = {**files, **changed}
    want, got = plain({k: v for k, v in after.items() if v}), digests(now)
    touched = {f for c in changed for f in ["", *("/".join(c.split("/")[:n]) for n in range(1, c.count("/") + 1))]}
    assert set(got) <= touched and all(want[f] == d for f, d in got.items()) and got[""] == want[""] != plain(files)[""]
    assert len(parts) <= len(touched) < len(want)
    assert tree_hash.folded(spark, tree_hash.files_of(listing({"a": "x"}).limit(0))).count() == 0
