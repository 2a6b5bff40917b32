"""What the command line and the servers share: building, updating, asking."""

from __future__ import annotations

import os
import shutil
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .errors import CannotUpdate, ModelUnavailable, Refused
from .operators import graph, search, state
from .plans import build as plans
from .plans import filenames, language, mesh
from .plans.classifier import Classifier, load_rules, vendored_repositories
from .sources import documents, files, git, markdown
from .store import Store, locked

PARTITIONS = {"m1": "document", "m2": "image", "m3": "markdown", "m4": "misc"}


class Workspace:
    """Stores of all models below one folder."""

    def __init__(self, spark: SparkSession, config: Config, folder: str, rules: dict | None = None) -> None:
        self.spark, self.config, self.folder = spark, config, folder
        rules = rules or load_rules()
        self.classifier = Classifier(config.root, config.dirs("image"), config.own_owners, tuple(vendored_repositories(config.root, config.own_owners, rules)), rules)

    def path(self, model: str) -> str:
        return os.path.join(self.folder, model)

    def store(self, model: str) -> Store:
        return Store.open(self.spark, self.path(model))

    def stores(self, models: tuple[str, ...] = tuple(PARTITIONS)) -> dict[str, Store]:
        return {m: self.store(m) for m in models if os.path.isfile(os.path.join(self.path(m), "_CURRENT"))}

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """`df` written beside the stores and read back: what several relations derive from is extracted once."""
        at = os.path.join(self.folder, "_staging", f"{name}-{uuid.uuid4().hex}")
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def cleared(self) -> None:
        shutil.rmtree(os.path.join(self.folder, "_staging"), ignore_errors=True)

    def decisions(self) -> DataFrame:
        return self.classifier.classify(files.walk(self.spark, self.config.root))

    def files(self, model: str) -> DataFrame:
        """(path, size, mtime) of a model's partition."""
        own = self.decisions().where(F.col("label") == PARTITIONS[model]).select("path")
        return files.stats(self.spark, self.config.root).join(own, "path", "left_semi")

    def contents(self, stats: DataFrame) -> DataFrame:
        """(path, content) of files that aren't large: the scan passes over the others by their length, without opening them."""
        every = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.config.root).where(F.col("length") <= files.LARGE)
        return every.select(files.plain(F.col("path")).alias("path"), "content").join(stats.select("path"), "path", "left_semi")

    def parts(self, model: str, as_of: str) -> tuple[plans.Parts, DataFrame]:
        """What a model's files give, and their state (path, size, mtime, content_hash)."""
        stats = self.staged(self.files(model), "stats")
        if model == "m2":
            named = self.staged(filenames.parsed_names(stats, as_of), "named")
            return plans.image_parts(self.spark, named, as_of, self.config.dirs("image")), stats.withColumn("content_hash", F.lit(None).cast("string"))
        content = self.contents(stats)
        current = self.staged(stats.join(content.select("path", F.sha2("content", 256).alias("content_hash")), "path", "left"), "current")
        if model == "m3":
            texts = content.select("path", F.decode("content", "UTF-8").alias("text"))
            found = markdown.extracted(texts, root=self.config.root, image_extensions=frozenset(self.classifier.rules["extensions"]["image"]), generated=self.config.generated_dirs)
            index = self.config.index_file and os.path.join(self.config.root, self.config.index_file)
            parts = plans.markdown_parts(self.spark, self.staged(found, "extracted"), self.config.root, index)
        elif model == "m1":
            parts = plans.document_parts(self.spark, self.staged(documents.extracted(content), "extracted"), self.config.root, self.classifier.known_extensions())
        else:
            parts = plans.misc_parts(self.spark, stats, content, as_of, self.config.root)
        stamped = parts.nodes if "mtime" in parts.nodes.columns else parts.nodes.join(current.select(F.col("path").alias("node_key"), "mtime"), "node_key", "left")
        if "content_hash" not in stamped.columns:
            stamped = stamped.join(current.select(F.col("path").alias("node_key"), "content_hash", F.col("size").alias("__s")), "node_key", "left")
            stamped = stamped.withColumn("size", F.coalesce("size", "__s") if "size" in stamped.columns else F.col("__s")).drop("__s")
        return plans.Parts(self.staged(stamped, "nodes"), self.staged(parts.edges, "edges"), parts.counts), current

    def build(self, model: str, as_of: str | None = None) -> Store:
        day = as_of or date.today().isoformat()
        if model not in PARTITIONS:
            raise Refused(f"no model {model!r}; there are {', '.join(PARTITIONS)}")
        with locked(self.path(model)):
            made = plans.built(self.spark, self.parts(model, day)[0], day, model, self.config.fingerprint()).commit(self.path(model))
            self.cleared()
            return made

    def update(self, model: str, as_of: str | None = None) -> Store:
        day = as_of or date.today().isoformat()
        if model not in PARTITIONS or model == "m4":
            raise CannotUpdate(f"{model} is not updated; build it anew")
        with locked(self.path(model)):
            parts, current = self.parts(model, day)
            made = plans.updated(self.store(model), parts, current, day, self.config.fingerprint()).commit(self.path(model))
            self.cleared()
            return made

    def pending(self, model: str) -> DataFrame:
        """(path, change) of files that were added, edited or removed since the store was written, by size and time alone."""
        stored = self.store(model).nodes.where("node_key = path").select("path", "size", "mtime", "content_hash")
        return state.differences(stored, self.files(model), use_hash=False).where("change <> 'unchanged'")

    def caught_up(self, model: str, as_of: str | None = None) -> bool:
        """Updates a model if anything is pending; whether there was."""
        if self.pending(model).isEmpty():
            return False
        self.update(model, as_of)
        return True

    def build_mesh(self, as_of: str | None = None, code: bool = False, repository: str | None = None, prune: bool = False) -> tuple[Store, list[str]]:
        day = as_of or date.today().isoformat()
        listed = files.code_inventory(self.spark, self.config.root, self.classifier, code)
        commits = git.commits(self.spark, repository) if repository else None
        with locked(self.path("m5")):
            before = self.stores(("m5",)).get("m5") if prune else None
            made, notes = mesh.build_mesh(self.spark, self.stores(), day, self.config.root, listed, commits, before, tuple(PARTITIONS) if prune else ())
            return made.commit(self.path("m5")), notes

    def mesh(self) -> Store:
        found = self.stores(("m5",))
        if "m5" not in found:
            raise ModelUnavailable("there is no mesh; build it")
        return found["m5"]

    def query(self, model: str, text: str) -> language.Answer:
        s = self.store(model)
        return language.run(text, s.nodes, s.edges)

    def search(self, model: str, text: str, limit: int = 20, mode: str = "auto", embedder=None, include_all: bool = False, subtype: str | None = None) -> search.Found:
        s = self.store(model)
        vectors = None if s.embeddings.limit(1).isEmpty() else s.embeddings
        return search.hybrid(s.index(), s.nodes, text, limit, mode, vectors if embedder else None, embedder, include_all=include_all, subtype=subtype)

    def mesh_search(self, text: str, limit: int = 10) -> mesh.MeshResult:
        found = self.stores(("m5",))
        return mesh.mesh_search(self.stores(), text, limit, found.get("m5"), files.stats(self.spark, self.config.root), tuple(PARTITIONS))

    def neighbours(self, key: str, depth: int = 1) -> DataFrame | None:
        m = self.mesh()
        full = graph.resolve_key(m.nodes, key)
        return None if full is None else graph.neighbours(m.nodes, m.edges, full, depth)

    def path_between(self, a: str, b: str, depth: int = 4) -> list[str] | None:
        m = self.mesh()
        keys = [graph.resolve_key(m.nodes, k) for k in (a, b)]
        return None if None in keys else graph.path(m.nodes, m.edges, *keys, depth)
