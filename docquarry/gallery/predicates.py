"""Every operation of the query model, over typed, open and row-stored layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.gallery.registry import CUSTOMER_ID, EVENT_ID, ORDER_ID, TEXT_ID, query, uid_sql
from docquarry.operators.text_index import TextIndex
from docquarry.plans.query import all_, and_, Corpus, find, matches, none_, or_, Q, quantity
from docquarry.session import work_folder
from docquarry.sources import tables as t
from docquarry.sources.documents import read_corpus, write_corpus


def _ids(df):
    return df.select("id")


# -- scalar predicates ---------------------------------------------------------------------
@query("exact_string", f"SELECT {CUSTOMER_ID} AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def exact_string(spark, folder):
    return _ids(find(t.customers(spark, folder), Q("customer.mktsegment", "exact_string", "BUILDING")))


@query("contains_string", f"SELECT {TEXT_ID} AS id FROM documents WHERE contains(text, 'license')")
def contains_string(spark, folder):
    return _ids(find(t.text_docs(spark, folder), Q("text_doc.text", "contains_string", "license")))


@query("regexp", f"SELECT {TEXT_ID} AS id FROM documents WHERE regexp_matches(text, '[0-9]{{3}}-[0-9]{{4}}')")
def regexp(spark, folder):
    return _ids(find(t.text_docs(spark, folder), Q("text_doc.text", "regexp", "[0-9]{3}-[0-9]{4}")))


@query(
    "regexp_anchored",
    f"SELECT {uid_sql(chr(39) + 'page:' + chr(39) + '||page_id')} AS id FROM pages WHERE regexp_matches(url, '^https://m[.]')",
)
def regexp_anchored(spark, folder):
    return _ids(find(t.pages(spark, folder), Q("page.url", "regexp", "^https://m[.]")))


@query("exact_number", f"SELECT {uid_sql(chr(39) + 'element:' + chr(39) + '||vec_id')} AS id FROM embeddings WHERE label = 3")
def exact_number(spark, folder):
    return _ids(find(t.elements(spark, folder), Q("element.label", "exact_number", 3)))


@query(
    "exact_number_array",
    f"SELECT {EVENT_ID} AS id FROM events WHERE day(ts) = 15 AND hour(ts) = 12",
)
def exact_number_array(spark, folder):
    return _ids(find(t.events(spark, folder), Q("event.slot", "exact_number", [15, 12])))


for _name, _op in (("lessthan", "<"), ("lessthaneq", "<="), ("greaterthan", ">"), ("greaterthaneq", ">=")):

    def _compare(spark, folder, name=_name):
        return _ids(find(t.orders(spark, folder), Q("order_doc.totalprice", name, 250000.5)))

    query(_name, f"SELECT {ORDER_ID} AS id FROM orders WHERE o_totalprice {_op} 250000.5")(_compare)


@query(
    "hasfield",
    """
    SELECT class_name, count(*) AS n_documents FROM (
      SELECT 'customer' AS class_name FROM customer UNION ALL SELECT 'supplier' FROM supplier
    ) GROUP BY class_name
    """,
)
def hasfield(spark, folder):
    found = find(t.open_corpus(spark, folder, heavy=True), Q("party.acctbal", "hasfield"))
    return found.groupBy("class_name").agg(F.count(F.lit(1)).alias("n_documents"))


@query(
    "not_hasfield",
    f"SELECT {EVENT_ID} AS id FROM events WHERE json_extract(props, '$.k') IS NULL OR value > 400",
)
def not_hasfield(spark, folder):
    tree = or_(~Q("event.props.k", "hasfield"), and_(~Q("event.props.q", "hasfield"), Q("event.value", "greaterthan", 400)))
    return _ids(find(t.events(spark, folder), tree))


# -- array predicates ------------------------------------------------------------------------
@query("hasmember_number", f"SELECT {EVENT_ID} AS id FROM events WHERE day(ts) = 12 OR hour(ts) = 12")
def hasmember_number(spark, folder):
    return _ids(find(t.events(spark, folder), Q("event.slot", "hasmember", 12)))


@query("hasmember_string", f"SELECT {TEXT_ID} AS id FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
def hasmember_string(spark, folder):
    return _ids(find(t.text_docs(spark, folder), Q("text_doc.words", "hasmember", "the")))


@query(
    "hasanysubfield_contains_string",
    f"""SELECT {TEXT_ID} AS id FROM documents
        WHERE len([x for x in string_split(text, chr(10)) if contains(x, 'http')]) > 0""",
)
def hasanysubfield_contains_string(spark, folder):
    return _ids(
        find(t.text_docs(spark, folder), Q("text_doc.lines", "hasanysubfield_contains_string", "text", "http"))
    )


@query(
    "any_line_regexp",
    f"""SELECT {TEXT_ID} AS id FROM documents
        WHERE len([x for x in string_split(text, chr(10)) if regexp_matches(x, '^[A-Z][a-z]+ on ')]) > 0""",
)
def any_line_regexp(spark, folder):
    return _ids(find(t.text_docs(spark, folder), Q("text_doc.lines[*].text", "regexp", "^[A-Z][a-z]+ on ")))


@query(
    "nested_iteration",
    f"""SELECT {TEXT_ID} AS id FROM documents
        WHERE len([x for x in string_split(text, chr(10))
                   if len([w for w in string_split(x, ' ') if regexp_matches(w, '^[0-9]+$')]) > 0]) > 0""",
)
def nested_iteration(spark, folder):
    return _ids(find(t.text_docs(spark, folder), Q("text_doc.lines[*].words[*].text", "regexp", "^[0-9]+$")))


@query(
    "any_order_line",
    f"""SELECT {ORDER_ID} AS id FROM orders
        WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)""",
)
def any_order_line(spark, folder):
    return _ids(find(t.order_corpus(spark, folder), Q("order_doc.lines[*].quantity", "greaterthan", 49)))


@query(
    "no_order_line",
    f"""SELECT {ORDER_ID} AS id FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)""",
)
def no_order_line(spark, folder):
    return _ids(find(t.order_corpus(spark, folder), ~Q("order_doc.lines[*].quantity", "greaterthan", 49)))


@query(
    "orders_without_lines",
    f"""SELECT {ORDER_ID} AS id FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
)
def orders_without_lines(spark, folder):
    return _ids(find(t.order_corpus(spark, folder), ~Q("order_doc.lines", "hasfield")))


@query(
    "independent_line_predicates",
    f"""SELECT {ORDER_ID} AS id FROM orders
        WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)
          AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
          AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')""",
)
def independent_line_predicates(spark, folder):
    tree = and_(
        Q("order_doc.lines[*].quantity", "greaterthan", 48),
        Q("order_doc.lines[*].returnflag", "exact_string", "R"),
        Q("order_doc.lines[*].linestatus", "~exact_string", "F"),
    )
    return _ids(find(t.order_corpus(spark, folder), tree))


@query(
    "any_turn_of_role",
    f"""SELECT {uid_sql("'conversation:'||conv_id")} AS id FROM conversations
        GROUP BY conv_id HAVING bool_or(contains(text, '?')) AND NOT bool_or(role = 'system')""",
)
def any_turn_of_role(spark, folder):
    tree = and_(
        Q("conversation.turns", "hasanysubfield_contains_string", "text", "?"),
        Q("conversation.turns[*].role", "~exact_string", "system"),
    )
    return _ids(find(t.conversation_corpus(spark, folder), tree))


# -- document predicates and composition -------------------------------------------------------
@query(
    "isa",
    f"""SELECT {CUSTOMER_ID} AS id FROM customer
        UNION ALL SELECT {uid_sql("'supplier:'||s_suppkey")} FROM supplier""",
)
def isa(spark, folder):
    return _ids(find(t.open_corpus(spark, folder), Q("", "isa", "party")))


@query("isa_by_class_name", "SELECT 'event' AS class_name, count(*) AS n_documents FROM events")
def isa_by_class_name(spark, folder):
    found = find(t.open_corpus(spark, folder), Q("", "isa", "epochid"), t.CATALOG, snapshot_checked=True)
    return found.groupBy("class_name").agg(F.count(F.lit(1)).alias("n_documents"))


@query("depends_on", f"SELECT {ORDER_ID} AS id FROM orders WHERE o_custkey = 7")
def depends_on(spark, folder):
    seven = spark.range(1).select(t.uid("customer:7")).first()[0]
    return _ids(find(t.orders(spark, folder), Q("", "depends_on", "customer_id", seven)))


@query(
    "negations",
    f"""SELECT {ORDER_ID} AS id FROM orders
        WHERE o_orderstatus <> 'F' AND NOT o_totalprice < 300000 AND o_custkey <> 7""",
)
def negations(spark, folder):
    seven = spark.range(1).select(t.uid("customer:7")).first()[0]
    tree = and_(
        Q("order_doc.status", "~exact_string", "F"),
        Q("order_doc.totalprice", "~lessthan", 300000),
        Q("order_doc.nosuchfield", "~regexp", "."),
        Q("order_doc.status", "~greaterthan", 0),
        ~Q("", "depends_on", "customer_id", seven),
        ~Q("", "isa", "party"),
    )
    return _ids(find(t.orders(spark, folder), tree))


@query(
    "or_of_ands",
    f"""SELECT {ORDER_ID} AS id FROM orders
        WHERE (o_orderstatus = 'F' AND o_totalprice > 400000) OR (o_orderpriority = '1-URGENT' AND o_totalprice < 20000)""",
)
def or_of_ands(spark, folder):
    tree = (Q("order_doc.status", "exact_string", "F") & Q("order_doc.totalprice", "greaterthan", 400000)) | (
        Q("order_doc.priority", "exact_string", "1-URGENT") & Q("order_doc.totalprice", "lessthan", 20000)
    )
    return _ids(find(t.orders(spark, folder), tree))


_COUNT_ALL = " + ".join(
    f"(SELECT count(*) FROM {name})"
    for name in (
        "customer", "supplier", "orders", "events", "embeddings", "documents", "labels", "pages", "part",
        "region", "nation", "customer",
    )
)


@query("all_and_none", f"SELECT {_COUNT_ALL} AS n_all, CAST(0 AS BIGINT) AS n_none")
def all_and_none(spark, folder):
    corpus = t.open_corpus(spark, folder)
    return corpus.agg(
        F.count_if(matches(corpus, all_())).alias("n_all"), F.count_if(matches(corpus, none_())).alias("n_none")
    )


@query(
    "query_from_struct",
    f"""SELECT {EVENT_ID} AS id FROM events
        WHERE (event_type = 'error' OR event_type = 'signup') AND value >= 100 AND user_id < 50""",
)
def query_from_struct(spark, folder):
    tree = [
        {
            "field": "",
            "operation": "or",
            "param1": [{"field": "event.event_type", "operation": "exact_string", "param1": "error"}],
            "param2": [{"field": "event.event_type", "operation": "exact_string", "param1": "signup"}],
        },
        {"field": "event.value", "operation": "greaterthaneq", "param1": 100},
        {"field": "event.user_id", "operation": "lessthan", "param1": 50},
    ]
    return _ids(find(t.events(spark, folder), tree))


@query(
    "bounded_elements",
    f"""SELECT {EVENT_ID} AS id FROM events WHERE extract(day FROM ts) > 27 OR extract(hour FROM ts) > 27
        UNION ALL SELECT {EVENT_ID} FROM events WHERE extract(day FROM ts) = 3 OR extract(hour FROM ts) = 3""",
)
def bounded_elements(spark, folder):
    """Conditions on elements of a stored list, by way of the bounds that were stored with it."""
    path = work_folder(spark, "bounded")
    write_corpus(t.opened(t.events(spark, folder)).sortWithinPartitions("datestamp"), path, bounds=["event.slot[*]"])
    docs = read_corpus(spark, path)
    late = find(docs, Q("event.slot[*]", "greaterthan", 27))
    return late.select("id").unionByName(find(docs, Q("event.slot", "hasmember", 3)).select("id"))


@query(
    "indexed_substring",
    f"""SELECT n, {TEXT_ID} AS id FROM documents, (VALUES (0), (1), (2), (3)) v(n)
        WHERE CASE n WHEN 0 THEN contains(text, 'tionsh') WHEN 1 THEN regexp_matches(text, '[a-z]ion[.] [A-Z]he[a-z]*sh')
                     WHEN 2 THEN contains(text, 'no such text') ELSE contains(text, '@e') END""",
)
def indexed_substring(spark, folder):
    """Literals and a pattern by way of the trigram index; what has no trigram is scanned."""
    index = TextIndex(f"{work_folder(spark, 'trigrams')}/texts", "text_doc.text", buckets=8)
    docs = t.text_docs(spark, folder)
    for batch in range(2):
        index.update(docs.where(F.char_length("text_doc.text") % 2 == batch), batch)
    out = None
    for n, (operation, value) in enumerate((
        ("contains_string", "tionsh"), ("regexp", "[a-z]ion[.] [A-Z]he[a-z]*sh"), ("contains_string", "no such text"), ("contains_string", "@e"),
    )):
        found = index.search(docs, Q("text_doc.text", operation, value), before=2).select(F.lit(n).alias("n"), "id")
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "queryable_guard",
    f"SELECT {CUSTOMER_ID} AS id FROM customer WHERE c_acctbal < 0 AND c_nationkey > 20",
)
def queryable_guard(spark, folder):
    tree = Q("party.acctbal", "lessthan", 0) & Q("party.nation", "greaterthan", 20)
    return _ids(find(t.customers(spark, folder), tree, t.CATALOG, not_queryable="raise"))


@query(
    "queryable_guard_refuses",
    """SELECT field, refused, count(*) AS n_documents FROM customer,
         (VALUES ('customer.key', true), ('customer.mktsegment', false)) v(field, refused)
       WHERE refused OR c_mktsegment = 'BUILDING' GROUP BY field, refused""",
)
def queryable_guard_refuses(spark, folder):
    """A field declared as not queryable is refused, and a caller takes all documents instead."""
    docs, parts = t.customers(spark, folder), []
    for leaf in (Q("customer.key", "greaterthan", 0), Q("customer.mktsegment", "exact_string", "BUILDING")):
        try:
            found, refused = find(docs, leaf, t.CATALOG, not_queryable="raise"), False
        except ValueError:
            found, refused = docs, True
        parts.append(found.select(F.lit(leaf.field).alias("field"), F.lit(refused).alias("refused")))
    return parts[0].unionByName(parts[1]).groupBy("field", "refused").agg(F.count(F.lit(1)).alias("n_documents"))


@query(
    "composite_subfield",
    f"""SELECT {EVENT_ID} AS id FROM events
        WHERE value * CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 60 ELSE 3600 END > 172800
          AND event_type NOT IN ('view', 'click')""",
)
def composite_subfield(spark, folder):
    tree = Q("event.elapsed.seconds", "greaterthan", 172800) & Q("event.elapsed.source_unit", "exact_string", "hour")
    return _ids(find(t.events(spark, folder), tree))


@query(
    "quantity_literal",
    f"""SELECT {EVENT_ID} AS id FROM events
        WHERE value * CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 60 ELSE 3600 END > 259200""",
)
def quantity_literal(spark, folder):
    return _ids(find(t.events(spark, folder), quantity("event.elapsed", "greaterthan", 3, "day", "duration")))


@query(
    "is_empty",
    f"""SELECT {uid_sql("'nation:'||n_nationkey")} AS id FROM nation
        UNION ALL SELECT {uid_sql("'directory:'||c_custkey")} FROM customer""",
)
def is_empty(spark, folder):
    return _ids(find(t.directories(spark, folder), Q("directory.directory_role", "is_empty")))


# -- the same model over VARIANT bodies -----------------------------------------------------------
@query(
    "open_layout_numbers",
    f"""SELECT {EVENT_ID} AS id FROM events
        WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90 AND value < 200 AND day(ts) = 10""",
)
def open_layout_numbers(spark, folder):
    tree = and_(
        Q("event.props.k", "greaterthaneq", 90),
        Q("event.value", "lessthan", 200),
        Q("event.slot", "hasmember", 10),
        Q("event.event_type", "~lessthan", 5),
        Q("epochid.epochid", "regexp", "-10$"),
    )
    return _ids(find(t.opened(t.events(spark, folder, heavy=True), read_often=True), tree))


@query(
    "open_layout_iteration",
    f"""SELECT {TEXT_ID} AS id FROM documents
        WHERE len([x for x in string_split(text, chr(10)) if contains(x, 'http')]) > 0
          AND NOT len([x for x in string_split(text, chr(10))
                       if len([w for w in string_split(x, ' ') if w = 'the']) > 0]) > 0""",
)
def open_layout_iteration(spark, folder):
    tree = and_(
        Q("text_doc.lines[*].text", "contains_string", "http"),
        Q("text_doc.lines[*].words[*].text", "~exact_string", "the"),
    )
    return _ids(find(t.opened(t.text_docs(spark, folder, heavy=True), read_often=True), tree))


@query(
    "mixed_corpus_numbers",
    """
    SELECT class_name, count(*) AS n_documents FROM (
      SELECT 'customer' AS class_name FROM customer WHERE c_acctbal > 9000
      UNION ALL SELECT 'supplier' FROM supplier WHERE s_acctbal > 9000
      UNION ALL SELECT 'order_doc' FROM orders WHERE o_totalprice > 450000
    ) GROUP BY class_name
    """,
)
def mixed_corpus_numbers(spark, folder):
    tree = Q("party.acctbal", "greaterthan", 9000) | Q("order_doc.totalprice", "greaterthan", 450000)
    found = find(Corpus(t.open_corpus(spark, folder, heavy=True)), tree)
    return found.groupBy("class_name").agg(F.count(F.lit(1)).alias("n_documents"))


@query(
    "flagship",
    f"""SELECT {ORDER_ID} AS id FROM orders
        WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)
          AND o_custkey <> 7""",
)
def flagship(spark, folder):
    seven = spark.range(1).select(t.uid("customer:7")).first()[0]
    tree = and_(
        Q("", "isa", "order_doc"),
        Q("order_doc.lines[*].quantity", "greaterthan", 49),
        Q("", "~depends_on", "customer_id", seven),
    )
    return _ids(find(t.order_corpus(spark, folder), tree))
