"""Registered queries of the operators over whole tables, with their SQL."""

from pyspark.sql import functions as F

from clearsift.llm import (
    decontamination,
    fill_in_middle,
    html_extraction,
    jaccard_join,
    language_id,
    lexical_search,
    packing,
    passage_dedup,
    quality_rules,
    sharding,
    url_filter,
    vector_join,
)
from clearsift.functions.scale import with_fields
from clearsift.plans.registry import query


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op6_cost_balanced_packing")
def op6_cost_balanced_packing(spark, folder):
    """Every piece of every document with its place in a sequence."""
    packed = packing.cost_balanced(table(spark, folder, "documents"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


@query("op9_best_fit_token_matrix")
def op9_best_fit_token_matrix(spark, folder):
    """Every packed sequence: its segments, and checksums of its matrix rows."""
    packed = packing.best_fit(table(spark, folder, "documents"))
    return packed.select(
        "sequence_id",
        F.element_at("cu_seqlens", -1).alias("n_tokens"),
        F.size("segments").alias("n_segments"),
        F.col("segments.doc_id").alias("doc_ids"),
        F.col("segments.start").alias("starts"),
        "cu_seqlens",
        F.crc32("input_ids").alias("ids_crc32"),
        F.crc32("position_ids").alias("positions_crc32"),
    )


@query("op1_html_main_text")
def op1_html_main_text(spark, folder):
    """The main text of every page."""
    pages = html_extraction.extract(table(spark, folder, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query(
    "op2_rendezvous_shards",
    """
    WITH numbered AS (
      SELECT *, row_number() OVER () AS pos FROM documents
    ), scored AS (
      SELECT pos, i, substr(md5(coalesce(doc_id::VARCHAR, '') || '#' || i), 1, 13) AS score
      FROM numbered, range(17) t(i)
    ), chosen AS (
      SELECT pos, arg_max(i, score) FILTER (i < 16) AS shard, arg_max(i, score) AS grown_shard
      FROM scored GROUP BY pos
    ), bits AS (
      SELECT list(c ORDER BY n) AS crc_table FROM (
        SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k:
          CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) t(n))
    )
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
      CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(
          range(1, 2 * octet_length(encode(text)), 2),
          lambda i: ('0x' || substr(hex(encode(text)), i, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]))) END AS text_crc32,
      'key' AS law, shard::INTEGER AS shard,
      row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot,
      grown_shard::INTEGER AS grown_shard
    FROM numbered JOIN chosen USING (pos), bits
    """,
)
def op2_rendezvous_shards(spark, folder):
    """Every document's shard among 16, its slot there, and its shard among 17."""
    rows = sharding.shard(table(spark, folder, "documents"), shards=16)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query("op4_boosted_url_filter")
def op4_boosted_url_filter(spark, folder):
    """Every page's verdict.  Labelled urls are pages whose path number names a
    labelled document: block where that is toxic or of low quality."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    number = F.regexp_extract(url_filter.path_of(F.col("url")), "/([0-9]{1,18})", 1)
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("number"),
        ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("double").alias("block"),
    )
    labelled = pages.withColumn("number", number.try_cast("long")).join(labels, "number")
    model = url_filter.train(labelled)
    return url_filter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict")


@query("op5_rank_order_language")
def op5_rank_order_language(spark, folder):
    """Every document's predicted language, learnt from four fifths of the ids."""
    docs = table(spark, folder, "documents")
    held = language_id.held_out(F.col("doc_id"))
    found = language_id.profiles(docs.where(~held))
    judged = language_id.identify(docs.select("doc_id", "text"), found)
    return judged.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query(
    "op7_line_frequency_rules",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
    ), w AS (
      SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
    ), win AS (
      SELECT r, p, array_to_string(words[p:p + 7], ' ') AS shingle
      FROM w, unnest(range(1, len(words) - 6)) t(p)
    ), twice AS (
      SELECT r, p FROM win
      QUALIFY count(*) OVER (PARTITION BY r, shingle) > 1
    ), repeated AS (
      SELECT r, count(DISTINCT q) AS n FROM twice, unnest(range(p, p + 8)) t(q) GROUP BY r
    ), lines AS (
      SELECT r, source, md5(text) AS digest, line,
        lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
      FROM d, unnest(string_split(text, chr(10))) t(line)
    ), worded AS (
      SELECT *, len(string_split(norm, ' ')) AS n FROM lines WHERE norm <> ''
    ), line_counts AS (
      SELECT source, norm, count(DISTINCT digest) AS n FROM worded GROUP BY ALL
    ), hosts AS (
      SELECT source, count(DISTINCT md5(text)) AS n FROM d GROUP BY ALL
    ), frequent AS (
      SELECT l.source, l.norm FROM line_counts l JOIN hosts h
        ON l.source IS NOT DISTINCT FROM h.source
      WHERE l.n > 10 AND 100 * l.n > 2 * h.n
    ), per_doc AS (
      SELECT r, count(*) - count(DISTINCT line) AS dup,
        coalesce(sum(x.n) FILTER (f.norm IS NOT NULL), 0) AS gone
      FROM worded x LEFT JOIN frequent f
        ON x.norm = f.norm AND x.source IS NOT DISTINCT FROM f.source
      GROUP BY r
    ), figures AS (
      SELECT doc_id, len(words)::BIGINT AS n_words,
        length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(dup, 0)::BIGINT AS n_dup_lines,
        coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
        coalesce(gone, 0) AS gone
      FROM d JOIN w USING (r) LEFT JOIN repeated USING (r) LEFT JOIN per_doc USING (r)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
      NOT base_failed AND 100 * (n_words - gone) >= 20 * n_words AS kept
    FROM figures
    """,
)
def op7_line_frequency_rules(spark, folder):
    """Every document's figures and verdict."""
    judged = quality_rules.judge(table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@query(
    "op8_ngram_decontamination",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
      FROM documents
    ), b AS (
      SELECT coalesce(item_id::VARCHAR, '') AS item,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
      FROM benchmark
    ), known AS (
      SELECT DISTINCT item, least(len(words), 10) AS n,
        array_to_string(words[p:p + least(len(words), 10) - 1], ' ') AS shingle
      FROM b, unnest(range(1, greatest(len(words) - 8, 2))) t(p) WHERE len(words) > 0
    ), win AS (
      SELECT r, p, n, array_to_string(words[p:p + n - 1], ' ') AS shingle
      FROM d, (SELECT DISTINCT n FROM known) k, unnest(range(1, len(words) - n + 2)) t(p)
    ), hits AS (
      SELECT r, p, n, item FROM win JOIN known USING (n, shingle)
    ), covered AS (
      SELECT r, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + n)) t(q) GROUP BY r
    ), named AS (
      SELECT r, list(DISTINCT item) AS items FROM hits GROUP BY r
    )
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
      coalesce(len(items), 0)::BIGINT AS n_items,
      sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
    """,
)
def op8_ngram_decontamination(spark, folder):
    """Every document's benchmark passages."""
    found = decontamination.scan(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"]
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op10_grouped_prefix_join")
def op10_grouped_prefix_join(spark, folder):
    """Every document's set size and the component it is linked into."""
    found = jaccard_join.similar_documents(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query("op3_collinear_chaining")
def op3_collinear_chaining(spark, folder):
    """Every passage that a document shares with an earlier one."""
    found = passage_dedup.passages(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "start", "end", (F.col("end") - F.col("start")).alias("n_words"),
        F.col("source_id").alias("source_doc_id"), "source_start", "source_end", "identity",
    )


@query(
    "op11_voronoi_knn_join",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
      FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), part AS (
      SELECT vec_id, i, e[i] AS x FROM v, unnest(range(1, len(e) + 1)) t(i)
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
      FROM part q JOIN part c ON q.i = c.i AND q.vec_id <> c.vec_id
      WHERE q.vec_id % 50 = 0
      GROUP BY ALL
    )
    SELECT query_id,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
      vec_id, score
    FROM scored
    QUALIFY rank <= 5
    """,
)
def op11_voronoi_knn_join(spark, folder):
    """The five best rows of every query row, by integer inner product."""
    vectors = vector_join.scaled(table(spark, folder, "embeddings"))
    queries = vectors.where(F.col("id") % 50 == 0)
    found = vector_join.top_k_join(queries, vectors, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query(
    "op12_skip_list_fill_in_middle",
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
        sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digest
      FROM documents
    ), h AS (
      SELECT *, len(lines) AS n,
        ('0x' || digest[1:8])::BIGINT % (len(lines) + 1) AS c1,
        ('0x' || digest[9:16])::BIGINT % (len(lines) + 1) AS c2,
        ('0x' || digest[17:24])::BIGINT % 100 AS h3, ('0x' || digest[25:32])::BIGINT % 100 AS h4
      FROM d
    ), cut AS (
      SELECT *, array_to_string(lines[1:least(c1, c2)], '') AS prefix,
        array_to_string(lines[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
        array_to_string(lines[greatest(c1, c2) + 1:], '') AS suffix,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
          OR contains(text, '<M>') OR h3 >= 100 THEN 'plain'
          WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form
      FROM h
    )
    SELECT doc_id, n, form,
      CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
      sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END)
        AS restored_sha256
    FROM cut
    """,
)
def op12_skip_list_fill_in_middle(spark, folder):
    """Every document's form, cuts, output and the text rebuilt from the output."""
    done = fill_in_middle.transform(table(spark, folder, "documents"))
    restored = fill_in_middle.restore(F.col("fim_output"), F.col("fim_form"))
    done = with_fields(done, F.sha2("fim_output", 256).alias("__o"), F.sha2(restored, 256).alias("__r"))
    return done.select(
        "doc_id", F.col("fim_lines").alias("n"), F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        F.col("__o").alias("output_sha256"), F.col("__r").alias("restored_sha256"),
    )


@query(
    "op13_automaton_ranked_search",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
      FROM documents
    ), b AS (
      SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
      FROM benchmark
    ), wanted AS (
      SELECT item_id, term, count(*) AS times FROM b, unnest(words) t(term) GROUP BY ALL
    ), size AS (
      SELECT count(*) FILTER (len(words) > 0) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d
    ), tf AS (
      SELECT r, term, count(*) AS tf FROM d, unnest(words) t(term)
      WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
    ), weights AS (
      SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM tf, size GROUP BY term, n_docs
    ), scored AS (
      SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) //
        (1000 * tf + 8 * (100 - 75 + (75 * len(words) * n_docs) // n_terms))))::BIGINT AS score
      FROM tf JOIN d USING (r) JOIN weights USING (term) JOIN wanted USING (term), size
      GROUP BY ALL
    )
    SELECT item_id,
      row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
      doc_id, score
    FROM scored WHERE score > 0
    QUALIFY rank <= 10
    """,
)
def op13_automaton_ranked_search(spark, folder):
    """The ten best documents of every benchmark item."""
    found = lexical_search.search(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10
    )
    return found.select("item_id", "rank", "doc_id", "score")
