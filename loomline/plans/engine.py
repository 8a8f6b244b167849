"""The two pipelines and everything around them, over stored tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.conf import EngineConf
from loomline.functions import models, stages, text
from loomline.operators import chronology, evaluation, graph, merge, retrieval, windows
from loomline.schemas import ANSWER, INSTRUCTION, STAGE, TABLES
from loomline.sources import store as stores
from loomline.sources.documents import accepted, form_feed_pages, pages_of, read_files
from loomline.sources.jobs import JobLog
from loomline.sources.store import Store

# The first line names the contract; what follows instructs a hosted model.
SKIM = "skim\nList what happens on these pages as bullets, each beginning with its pages: - [PAGE n] or - [PAGE n, m]."
STAGES = "stages\nName 5 to 7 stages of this book in the order of story time, with a short description each, and mark those that frame the story. Reply as JSON: {stages: [{name, description, is_framing}]}."
MERGE = "merge\nTurn each bullet into one instruction. Use the stages' exact names as anchors and the known events' exact names for matches. Reply as JSON: {instructions: [{is_duplicate, matched_event_name, category, inferred_event}]}."
TIMELINE = "timeline\nAnswer from the events, which stand in true story order, and cite pages. Reply as JSON: {answer, used_event_ids}."
NAIVE = "naive\nAnswer briefly and decisively from the passages. If asked about before or after, choose one."
KINDS = ("naive", "timeline")


class Engine:
    def __init__(self, spark: SparkSession, conf: EngineConf | None = None, make_client: Callable[[], models.ModelClient] | None = None):
        self.spark, self.conf = spark, conf or EngineConf()
        dim = self.conf.embed_dim
        self.make_client = make_client or (lambda: models.OfflineClient(dim))
        self.store = Store(spark, self.conf)
        self.jobs = JobLog(self.store)

    # documents

    def ingest(self, path: str, parser=form_feed_pages, glob: str | None = None, only_pdf: bool = False) -> DataFrame:
        """Read files, store the accepted documents and their pages, and return the documents."""
        docs, pages = read_files(self.spark, path, parser, glob)
        return self.add(accepted(docs, pages, only_pdf), pages)

    def add(self, docs: DataFrame, pages: DataFrame) -> DataFrame:
        ids = docs.select(F.col("id").alias("doc_id"))
        self.store.replace("pages", pages.join(ids, "doc_id", "left_semi"), ids)
        self.store.put_documents(docs)
        return self.store.read("documents").join(docs.select("id"), "id", "left_semi")

    def documents(self) -> DataFrame:
        return stores.document_list(self.store.read("documents"), self.store.read("chunks"), self.store.read("events"))

    def delete(self, doc_id: str) -> None:
        self.store.delete(doc_id)

    def pages(self, doc_id: str) -> DataFrame:
        """A document's pages in order; an unknown document is an error."""
        out = pages_of(self.store.read("pages", doc_id), doc_id)
        if out.isEmpty():
            raise LookupError(f"no pages of {doc_id}")
        return out

    def ids(self, *doc_ids: str) -> DataFrame:
        return self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")

    # builds

    def build(self, doc_id: str, kind: str) -> str:
        """Run a build as a job and return the job's id."""
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        self.pages(doc_id)
        job = self.jobs.create(doc_id, kind)
        self.jobs.run(job, self.work(doc_id, kind))
        return job

    def work(self, doc_id: str, kind: str) -> Callable[[Callable], str]:
        """What a job for one document does; it fails if the document's build does."""

        def run(progress: Callable) -> str:
            found = self._build(self.ids(doc_id), kind, progress).first()
            if found is None:
                raise RuntimeError("windows have no observation; the finished ones are kept")
            return found.detail

        return run

    def build_all(self, doc_ids: DataFrame, kind: str) -> DataFrame:
        """Build all documents of ``doc_ids(doc_id)`` at once and return their jobs ``job_id, doc_id``: every step is one plan over all of them."""
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        known = self._kept("build-ids", self.store.read("pages", doc_ids).select("doc_id").distinct())
        jobs = self._kept("build-jobs", self.jobs.create_all(known, kind))
        self.jobs.finish_all(jobs, self._build(known, kind))
        return jobs

    def _build(self, ids: DataFrame, kind: str, progress: Callable = lambda p, s: None) -> DataFrame:
        return (self.build_naive if kind == "naive" else self.build_timeline)(ids, progress)

    def _kept(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows written under the engine's work folder, so that nothing that made them runs again."""
        path = f"{self.conf.table('work')}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def build_naive(self, ids: DataFrame, progress: Callable = lambda p, s: None) -> DataFrame:
        """Chunks and vectors of documents; returns ``doc_id, detail``."""
        chunks = windows.char_chunks(self.store.read("pages", ids), self.conf.chunk_chars, self.conf.chunk_overlap)
        self.store.replace("chunks", models.embed(chunks, self.make_client, "content", batch=self.conf.embed_batch), ids)
        progress(0.9, "chunks stored")
        counts = evaluation.row_counts(ids, chunks=self.store.read("chunks", ids))
        return counts.select("doc_id", F.to_json(F.struct("chunks")).alias("detail"))

    SKIMMED = "doc_id string, window_id string, page_start int, page_end int, raw_text string, key string"

    def observe(self, ids: DataFrame) -> DataFrame:
        """Skim the windows whose text was not skimmed before, store the observations of documents that have all of theirs, and return these documents' ids."""
        work = windows.page_windows(self.store.read("pages", ids), self.conf.window_pages, self.conf.window_overlap)
        head = F.format_string("[Text Window: Pages %d to %d]\n\n", "page_start", "page_end")
        work = work.withColumns({"user": F.concat(head, "text"), "system": F.lit(SKIM)}).withColumn("key", F.sha1(F.concat_ws("\x1f", "doc_id", "window_id", "text")))
        todo = stores.pending(work, self._skimmed(), ["key"])
        new = models.chat(todo, self.make_client, "system", "user", max_tokens=1600, partitions=self.conf.model_partitions, ladder=self.conf.prompt_chars)
        new.where("reply is not null").select("doc_id", "window_id", "page_start", "page_end", F.col("reply").alias("raw_text"), "key").write.mode("append").parquet(self.conf.table("skimmed"))
        done = self._skimmed()
        missing = work.join(done, "key", "left_anti").select("doc_id").distinct()
        whole = self._kept("observed", ids.join(missing, "doc_id", "left_anti"))
        found = stores.latest(done.join(work.select("key"), "key", "left_semi"), ["key"], "raw_text").drop("key")
        self.store.replace("observations", found.join(whole, "doc_id", "left_semi"), whole)
        return whole

    def _skimmed(self) -> DataFrame:
        path = self.conf.table("skimmed")
        return self.spark.read.schema(self.SKIMMED).parquet(path) if self.store._exists(path) else self.spark.createDataFrame([], self.SKIMMED)

    def infer_stages(self, observations: DataFrame) -> None:
        """Ask for each document's stages and save them normalised; the default ones if the reply is of no use."""
        digests = windows.digest(observations, self.conf.digest_chars)
        asked = stores.titles(digests, self.store.read("documents")).join(digests, "doc_id")
        asked = asked.select("doc_id", F.lit(STAGES).alias("system"), F.concat(F.lit("TITLE: "), "title", F.lit("\n\n"), "digest").alias("user"))
        reply = models.chat(asked, self.make_client, "system", "user", max_tokens=2000, structured=True, ladder=self.conf.prompt_chars)
        found = F.from_json("reply", f"struct<stages:array<{STAGE}>>")["stages"]
        each = reply.select("doc_id", F.when(F.coalesce(F.size(found), F.lit(0)) > 0, stages.normalize(found)).otherwise(stages.default_stages()).alias("taxonomy"))
        self.store.save_taxonomies(self._kept("stages", each))

    def merge_observations(self, observations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Instructions and failed batches, round by round: the batches of a round see the events of their document's rounds before."""
        path = f"{self.conf.table('work')}/merge-{uuid.uuid4().hex}"
        work = self._kept("batches", windows.batches(observations, self.conf.batch_windows, self.conf.concurrency))
        pages = self._kept("pages", self.store.read("pages", ids).groupBy("doc_id").agg(F.max("page_no").alias("pages")))
        lines = self.stage_lines(ids)
        rounds = work.agg(F.max("round")).first()[0]
        for r in range(0 if rounds is None else rounds + 1):
            now = work.where(F.col("round") == r)
            known = merge.fold_arrow(self._instructions(path).join(now.select("doc_id"), "doc_id", "left_semi"))
            asked = merge.merge_prompt(now, merge.light_index(known), lines, pages).select("doc_id", "batch", F.lit(MERGE).alias("system"), "user")
            models.chat(asked, self.make_client, "system", "user", max_tokens=6000, structured=True, partitions=self.conf.concurrency, ladder=self.conf.prompt_chars).write.mode("append").parquet(path)
        return self._instructions(path), self._replies(path).where("reply is null").select("doc_id", "batch")

    def _replies(self, path: str) -> DataFrame:
        schema = f"doc_id string, batch int, {models.REPLY}"
        return self.spark.read.schema(schema).parquet(path) if self.store._exists(path) else self.spark.createDataFrame([], schema)

    def _instructions(self, path: str) -> DataFrame:
        rows = self._replies(path).where("reply is not null").select("doc_id", "batch", F.posexplode(F.from_json("reply", f"struct<instructions:array<{INSTRUCTION}>>")["instructions"]).alias("pos", "i"))
        return rows.select("doc_id", "batch", "pos", "i.*")

    def stage_lines(self, ids: DataFrame) -> DataFrame:
        """``doc_id, lines``: the documents' stages as numbered prompt lines."""
        t = self.store.taxonomies(ids).select("doc_id", F.posexplode("taxonomy").alias("i", "s"))
        return t.groupBy("doc_id").agg(text.ordered_text(["i"], stages.line(F.col("i"), F.col("s")), "\n").alias("lines"))

    def build_timeline(self, ids: DataFrame, progress: Callable = lambda p, s: None) -> DataFrame:
        """Observations, stages, events and graph of documents; returns ``doc_id, detail`` of those whose windows could all be read."""
        ids = self.observe(ids)
        observations = self.store.read("observations", ids)
        progress(0.42, "windows read")
        self.infer_stages(observations)
        progress(0.48, "stages named")
        instructions, failed = self.merge_observations(observations, ids)
        self.store.replace("instructions", instructions, ids)
        progress(0.80, "observations merged")
        events = chronology.with_ids(chronology.chronology(merge.fold_arrow(self.store.read("instructions", ids)), self.store.taxonomies(ids)))
        described = events.withColumn("_text", text.event_text(F.col("event_name"), F.col("core_event"), F.col("characters"), F.col("location")))
        self.store.replace("events", models.embed(described, self.make_client, "_text", batch=self.conf.embed_batch), ids)
        progress(0.93, "events stored")
        stored = chronology.ranked(self.store.read("events", ids))
        candidates = self._kept("candidates", graph.chain(stored).unionByName(graph.causal(stored)))
        combined = graph.combine(candidates)
        self.store.replace("edges", graph.repair(combined, stored), ids)
        self.store.replace("appears_in", graph.appears_in(stored), ids)
        progress(0.94, "graph stored")
        return self._kept("details", self._details(ids, stored, observations, failed, graph.repair_stats(candidates, combined, stored)))

    def _details(self, ids: DataFrame, events: DataFrame, observations: DataFrame, failed: DataFrame, repaired: DataFrame) -> DataFrame:
        s = evaluation.summary(ids, events).select("doc_id", F.col("events_total").alias("events"), F.col("events_major").alias("major"), F.col("events_minor").alias("minor"), "merges")
        counts = evaluation.row_counts(ids, windows=observations, failed=failed)
        names = self.store.taxonomies(ids).select("doc_id", stages.names(F.col("taxonomy")).alias("taxonomy"))
        edges = repaired.select("doc_id", F.struct(*(c for c in repaired.columns if c != "doc_id")).alias("edges"))
        x = s.join(counts, "doc_id").join(names, "doc_id").join(edges, "doc_id", "left")
        return x.select("doc_id", F.to_json(F.struct(*(c for c in x.columns if c != "doc_id"))).alias("detail"))

    # reading

    def ranked_events(self, doc_id: str) -> DataFrame:
        return chronology.ranked(self.store.read("events", doc_id))

    def events(self, doc_id: str) -> DataFrame:
        return self.ranked_events(doc_id).drop("embedding").orderBy("rank")

    def graph(self, doc_id: str) -> tuple[DataFrame, DataFrame]:
        own = self.store.read("events", doc_id)
        return graph.nodes(own), graph.edges_between(self.store.read("edges", doc_id), own)

    def observations(self, doc_id: str, limit: int = 20) -> DataFrame:
        return stores.observation_list(self.store.read("observations", doc_id), doc_id, limit)

    def taxonomy(self, doc_id: str) -> DataFrame:
        self.pages(doc_id)
        return self.store.taxonomies(self.ids(doc_id))

    def metrics(self, doc_id: str, gold: DataFrame | None = None) -> dict:
        """Everything that is measured of a document; the order's quality only against a ``gold(doc_id, pos, event_name)``."""
        doc = self.spark.range(1).select(F.lit(doc_id).alias("doc_id"))
        events = self.ranked_events(doc_id)
        own = lambda t: self.store.read(t, doc_id)
        out = evaluation.summary(doc, events).first().asDict()
        out |= evaluation.row_counts(doc, chunks=own("chunks"), observations=own("observations")).first().asDict()
        runs = evaluation.run_averages(own("query_runs")).first()
        out |= runs.asDict() if runs else {"runs": 0, "avg_naive_ms": 0, "avg_timeline_ms": 0, "avg_naive_tokens": 0, "avg_timeline_tokens": 0}
        out["stage_distribution"] = {r.timeline_anchor: r.n for r in evaluation.stage_distribution(events).collect()}
        out["pairwise_accuracy"] = out["kendall_tau"] = None
        if gold is not None:
            system = events.select("doc_id", F.col("rank").alias("pos"), "event_name")
            for measure in (evaluation.pairwise_accuracy, evaluation.kendall_tau):
                row = measure(system, gold.where(F.col("doc_id") == doc_id)).first()
                out[measure.__name__] = row[1] if row else None
        return out

    def health(self) -> bool:
        return stores.healthy(self.spark)

    # questions

    def _embedded(self, question: str) -> list[float]:
        return self.make_client().embed([question.replace("\n", " ")[:8000]])[0]

    def _ask(self, system: str, user: str, **how) -> dict:
        return models.ask(self.make_client(), system, user, how.pop("temperature", 0.1), how.pop("max_tokens", 800), ladder=self.conf.prompt_chars, **how)

    def ask_naive(self, doc_id: str, question: str, k: int | None = None) -> dict:
        began = time.perf_counter()
        chunks = self.store.read("chunks", doc_id)
        hits = retrieval.top_k(chunks, self._embedded(question), k or self.conf.top_chunks, ["chunk_index"], doc_id).select("doc_id", "chunk_index", "page_start", "page_end", "content", "score").collect()
        trace = [f"embedded the question into {self.conf.embed_dim} numbers", f"found the {len(hits)} nearest chunks", "put them into the prompt by similarity, not by story order"]
        held = self.spark.createDataFrame([(*h, i) for i, h in enumerate(hits, 1)], "doc_id string, chunk_index int, page_start int, page_end int, content string, score double, place int")
        context = lambda short: (retrieval.passage_context(held, short).first() or {"context": ""})["context"]
        user = lambda c: f"PASSAGES (by similarity):\n\n{c}\n\nQUESTION: {question}"
        first = self._ask(NAIVE, user(context(False)), temperature=0.4)
        if first["filtered"]:
            held = held.where("place <= 3")
            first = self._ask(NAIVE, user(context(True)), temperature=0.4, max_tokens=400)
        calls, second = [first], None
        low = (first["reply"] or "").lower()
        if any(p in low for p in text.REFUSALS):
            second = self._ask(NAIVE, user(context(False)) + "\n\nThe last reply refused. Choose and answer.", temperature=0.7, max_tokens=400)
            calls.append(second)
            trace.append("the model refused and was asked again")
        answers = self.spark.createDataFrame([(doc_id, first["reply"], second and second["reply"])], "doc_id string, first string, second string")
        answer = retrieval.final_answer(held, answers).first().answer
        found = retrieval.retrieved_passages(held).orderBy("rank").collect()
        cites = [{"label": f"Passage {r.rank}", "pages": r.cited_pages} for r in found]
        return self._result("naive", answer, began, calls, cites, [r.asDict() for r in found], trace)

    def ask_timeline(self, doc_id: str, question: str, k: int | None = None) -> dict:
        began = time.perf_counter()
        events = self.store.read("events", doc_id)
        edges = self.store.read("edges", doc_id)
        seeds = retrieval.top_k(events, self._embedded(question), k or self.conf.top_events, ["id"], doc_id).select("doc_id", "id", "event_name", "score").collect()
        trace = [f"found {len(seeds)} events by meaning"]
        s = self.spark.createDataFrame([(r.doc_id, r.id) for r in seeds], "doc_id string, id string")
        held = retrieval.working_set(events.drop("embedding"), s, graph.neighbours(edges, s)).orderBy("place")
        rows = held.collect()
        held = self.spark.createDataFrame(rows, held.schema)
        trace += [f"added {len(rows) - len(seeds)} events along the edges", "sorted the events by stage and page, not by similarity"]
        if len(seeds) >= 2:
            ranks = self.ranked_events(doc_id).select("doc_id", "id", "rank")
            pair = self.spark.createDataFrame([(doc_id, seeds[0].id, seeds[1].id)], "doc_id string, src string, dst string")
            rel = graph.reachable(graph.repair(edges, ranks), pair, self.conf.max_hops).first()
            trace.append(f"'{seeds[0].event_name}' is {rel.relation} '{seeds[1].event_name}' by {len(rel.chain)} events" if rel.chain else f"the two nearest events are {rel.relation}")
        context = lambda slim: (retrieval.event_context(held, slim).first() or {"context": ""})["context"]
        user = lambda c: f"EVENTS IN TRUE STORY ORDER:\n\n{c}\n\nQUESTION: {question}"
        calls = [self._ask(TIMELINE, user(context(False)), max_tokens=1200, valid=models.is_json)]
        if calls[0]["filtered"]:
            held = held.where("place <= 10")
            calls.append(self._ask(TIMELINE, user(context(True)), valid=models.is_json))
        reply = self.spark.createDataFrame([(calls[-1]["reply"],)], "reply string").select(F.from_json("reply", ANSWER).alias("a")).first().a
        used = F.array(*map(F.lit, reply.used_event_ids or [])).cast("array<string>") if reply else F.array().cast("array<string>")
        cites = [{"label": r.event_name, "pages": r.source_pages} for r in retrieval.cited(held, used).orderBy("place").collect()]
        found = [r.asDict() for r in retrieval.retrieved_events(held).orderBy("rank").collect()]
        return self._result("timeline", reply.answer if reply else None, began, calls, cites, found, trace)

    @staticmethod
    def _result(pipeline: str, answer: str | None, began: float, calls: list[dict], citations: list[dict], retrieved: list[dict], trace: list[str]) -> dict:
        return {
            "pipeline": pipeline, "answer": answer, "latency_ms": int((time.perf_counter() - began) * 1000), "prompt_tokens": sum(c["prompt_tokens"] for c in calls),
            "completion_tokens": sum(c["completion_tokens"] for c in calls), "filtered": bool(calls[-1]["filtered"]), "citations": citations, "retrieved": retrieved, "trace": trace,
        }

    def compare(self, doc_id: str, question: str) -> dict:
        """Ask both pipelines and record the run."""
        naive, timeline = self.ask_naive(doc_id, question), self.ask_timeline(doc_id, question)
        tokens = lambda x: x["prompt_tokens"] + x["completion_tokens"]
        schema = ", ".join(c for c in TABLES["query_runs"].split(", ") if not c.startswith("created_at"))
        row = self.spark.createDataFrame([(doc_id, question, naive["answer"], naive["latency_ms"], tokens(naive), timeline["answer"], timeline["latency_ms"], tokens(timeline))], schema)
        self.store.append("query_runs", row.withColumn("created_at", F.current_timestamp()))
        return {"naive": naive, "timeline": timeline}
