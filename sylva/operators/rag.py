"""Prompts for retrieval-augmented generation and plain chats, and checks of generated annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.operators.clients import complete
from sylva.operators.knn import knn
from sylva.operators.tree import ident

# The tags of the chat template.
SYSTEM = "<|start_header_id|>system<|end_header_id|>\n\n"
USER = "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n"
ASSISTANT = "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"
ANSWER = "\n<|eot_id|>\n<|start_header_id|>assistant<|end_header_id|>\n\n"

# How a passage is announced and ended, and the tags of the models that name clusters and mend names.
CONTEXT, CONTEXT_END = "Context ", " \n "
NAMING_SYSTEM, NAMING_USER = "<|header_start|>system<|header_end|>\n", "<|eot|>\n<|header_start|>user<|header_end|>\n"
MENDING_SYSTEM, MENDING_USER = "<|start|>system<|message|>", "<|end|>\n<|start|>user<|message|>\n"

#: What the roles of annotation are told; any other text may be given.
ANNOTATE = "Name the field that these documents share, in a few words and without comment.\n"
CORRECT = "The text below should have been one name of a field. Give that name alone, on one line of at most 80 characters.\n"
UNIFY = "Give the one name of a field that covers all names below, no wider than needed, on one line of at most 80 characters.\n"

WITH_CONTEXT = "Answer the user with the help of these passages.\n"
PLAIN = "Answer the user as well as you can.\n"


def contexts(ordered: Column) -> Column:
    """`Context i:` and the text for each text of an ordered array."""
    return F.array_join(F.transform(ordered, lambda t, i: F.concat(F.lit(CONTEXT), (i + 1).cast("string"), F.lit(":\n"), t, F.lit(CONTEXT_END))), "")


def conversation(turns: DataFrame, user: str = USER, assistant: str = ASSISTANT) -> DataFrame:
    """conv_id, turn, history for each user turn of (conv_id, turn, role, text): the conversation up to it, ready for an answer.

    User texts stand between the tags; answers follow as they are; turns of other roles are left out.
    """
    part = F.when(F.col("role") == "user", F.concat(F.lit(user), F.coalesce("text", F.lit("")), F.lit(assistant))).otherwise(F.coalesce("text", F.lit("")))
    said = turns.where(F.col("role").isin("user", "assistant")).select("conv_id", F.struct("turn", "role", part.alias("part")).alias("t"))
    whole = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("all"))
    upto = lambda i: F.array_join(F.transform(F.slice("all", F.lit(1), i), lambda t: t["part"]), "")
    each = whole.select("conv_id", F.explode(F.transform("all", lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), upto(i + 1).alias("history")))).alias("h"))
    return each.where("h.role = 'user'").select("conv_id", "h.turn", "h.history")


def rag_prompts(retrieved: DataFrame, history: DataFrame, system: str = WITH_CONTEXT) -> DataFrame:
    """query_id, prompt: system header, the retrieved texts by rank, and the conversation so far.

    retrieved has (query_id, rank, text), history (query_id, history).
    """
    ordered = retrieved.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text")))).alias("all"))
    body = contexts(F.transform("all", lambda x: x["text"]))
    return history.join(ordered.select("query_id", body.alias("body")), "query_id", "left").select("query_id", F.concat(F.lit(SYSTEM + system), F.coalesce("body", F.lit("")), "history").alias("prompt"))


def retrieve(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", bits: int | None = None) -> DataFrame:
    """query_id, rank, text of the k nearest rows of corpus (row_id, vector, text) to each query (row_id, vector)."""
    return knn(queries, corpus, k, metric, bits).join(corpus.select("row_id", "text"), "row_id").select("query_id", "rank", "text")


def latest_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, text of the last user turn of each conversation: what is embedded to find passages."""
    said = turns.where("role = 'user'").groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("t"))
    return said.select("conv_id", "t.turn", "t.text")


def conversation_prompts(turns: DataFrame, corpus: DataFrame, embed, k: int, metric: str = "cosine", bits: int | None = None, system: str = WITH_CONTEXT) -> DataFrame:
    """query_id (the conversation), prompt at its last user turn: that turn alone is embedded, the k nearest texts of corpus
    (row_id, vector, text) come first, and the whole conversation so far follows.

    `embed` takes (row_id, text) and gives (row_id, vector).
    """
    last = latest_turns(turns)
    asked = embed(last.select(F.col("conv_id").alias("row_id"), "text"))
    history = conversation(turns).join(last.select("conv_id", "turn"), ["conv_id", "turn"]).groupBy(F.col("conv_id").alias("query_id")).agg(F.max("history").alias("history"))
    return rag_prompts(retrieve(asked, corpus, k, metric, bits), history, system)


def chat_prompts(turns: DataFrame, system: str = PLAIN) -> DataFrame:
    """conv_id, turn, prompt for each user turn, without retrieval."""
    parts = F.when(F.col("role") == "user", F.concat(F.lit(USER), F.coalesce("text", F.lit("")), F.lit(ANSWER))).otherwise(F.coalesce("text", F.lit("")))
    said = turns.where(F.col("role").isin("user", "assistant")).select("conv_id", F.struct("turn", "role", parts.alias("part")).alias("t"))
    whole = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("all"))
    upto = lambda i: F.array_join(F.transform(F.slice("all", F.lit(1), i), lambda t: t["part"]), "")
    each = whole.select("conv_id", F.explode(F.transform("all", lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), upto(i + 1).alias("history")))).alias("h"))
    return each.where("h.role = 'user'").select("conv_id", "h.turn", F.concat(F.lit(SYSTEM + system), F.col("h.history")).alias("prompt"))


def completion_request(prompt: Column, n_tokens: int) -> Column:
    """The JSON body of a streamed completion."""
    return F.to_json(F.struct(prompt.alias("prompt"), F.lit(n_tokens).alias("n_predict"), F.lit(True).alias("stream")))


def stream_content(lines: Column) -> Column:
    """The answer in an array of `data:{...}` events, in order; other lines add nothing."""
    return F.array_join(F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.coalesce(F.get_json_object(F.substr(x, F.lit(6)), "$.content"), F.lit(""))), "")


def whole_content(response: Column) -> Column:
    """The answer in a response that is not streamed; null where it is no such object."""
    return F.get_json_object(response, "$.content")


def embedding_request(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("content")))


def decode_embedding(response: Column) -> Column:
    """The vector of an embedding response, or null where the server calls the input too large or answers otherwise."""
    parsed = F.from_json(response, "array<struct<index:int,embedding:array<array<double>>>>")
    return F.try_element_at(F.try_element_at(parsed, F.lit(1))["embedding"], F.lit(1))


def too_large(response: Column) -> Column:
    return F.coalesce(F.get_json_object(response, "$.error.message").contains("input is too large"), F.lit(False))


#: Longest acceptable annotation, and how much of a bad one goes to the corrector.
LONGEST, TAIL = 80, 20_000


def annotation_check(answers: DataFrame) -> DataFrame:
    """answers (..., text) with bad (more than one line, or too long) and correction_input (its end, where bad)."""
    bad = (F.instr(F.rtrim("text"), "\n") > 0) | (F.length("text") > LONGEST)
    return answers.withColumn("bad", F.coalesce(bad, F.lit(True))).withColumn("correction_input", F.when(F.col("bad"), F.right("text", F.lit(TAIL))))


def annotation_prompt(role: str, text: Column, system: str | None = None) -> Column:
    """The prompt of a role, `annotate`, `correct` or `unify`, over documents, a bad answer, or names."""
    head = {"annotate": (NAMING_SYSTEM, ANNOTATE, NAMING_USER), "correct": (MENDING_SYSTEM, CORRECT, MENDING_USER), "unify": (MENDING_SYSTEM, UNIFY, MENDING_USER)}[role]
    return F.concat(F.lit(head[0] + (head[1] if system is None else system) + head[2]), F.coalesce(text, F.lit("")))


def unification_prompts(named: DataFrame, system: str | None = None) -> DataFrame:
    """layer, cluster, chunks, label, prompt for the names (layer, cluster, chunk, label) that chunks of a cluster were given.

    One name is the cluster's label and needs no prompt; of several, distinct and in order, the prompt asks for one. Null
    and blank names count for nothing.
    """
    said = named.withColumn("label", F.trim("label")).where("label <> ''").groupBy("layer", "cluster").agg(F.countDistinct("chunk").alias("chunks"), F.array_sort(F.collect_set("label")).alias("all"))
    alone = F.size("all") == 1
    return said.select("layer", "cluster", "chunks", F.when(alone, F.element_at("all", 1)).alias("label"), F.when(~alone, annotation_prompt("unify", F.array_join("all", "\n"), system)).alias("prompt"))


def unify(named: DataFrame, completer, system: str | None = None) -> DataFrame:
    """layer, cluster, label: the names of a cluster's chunks brought to one by `completer`, a prompt to its answer."""
    asked = unification_prompts(named, system).withColumn("query_id", ident(F.col("layer"), F.col("cluster")))
    answers = complete(asked.where("prompt is not null"), completer)
    joined = asked.join(answers.groupBy("query_id").agg(F.max("answer").alias("answer")), "query_id", "left")
    return joined.select("layer", "cluster", F.coalesce("label", F.trim("answer")).alias("label"))
