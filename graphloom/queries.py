"""The registered queries of the SPARQL engine, each with SQL that gives the same rows.

``SPARQL`` holds plain queries over the mapped tables as (query, SQL); ``MORE``
holds those that need seeds, other data or other modes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import tables
from graphloom.linked_queries import QUERIES as LINKED
from graphloom.market_queries import QUERIES as MARKET
from graphloom.functions import values as V
from graphloom.functions.terms import RDF_TYPE, XSD, Literal, n3
from graphloom.tables import DATA, NS

_CUST = "SELECT 'urn:data:customer/' || c_custkey"

SPARQL: dict[str, tuple[str, str]] = {
    "bgp_path": (
        'SELECT ?name ?price WHERE { ?o t:placedBy ?c ; t:o_totalprice ?price . ?c t:c_name ?name ; t:inNation ?n . ?n t:inRegion ?r . ?r t:r_name "ASIA" FILTER(?price > 200000) }',
        "SELECT c_name AS name, o_totalprice AS price FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name='ASIA' AND o_totalprice>200000",
    ),
    "bgp_star": (
        'SELECT ?c ?name ?bal WHERE { ?c a t:Customer ; t:c_name ?name ; t:c_acctbal ?bal ; t:c_mktsegment "BUILDING" }',
        f"{_CUST} AS c, c_name AS name, c_acctbal AS bal FROM customer WHERE c_mktsegment='BUILDING'",
    ),
    "bgp_cycle": (
        "SELECT ?ok ?lk WHERE { ?l t:ofOrder ?o ; t:suppliedBy ?s ; t:l_linenumber ?lk . ?o t:placedBy ?c ; t:o_orderkey ?ok . ?c t:inNation ?n . ?s t:inNation ?n }",
        "SELECT o_orderkey AS ok, l_linenumber::BIGINT AS lk FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey WHERE c_nationkey=s_nationkey",
    ),
    "bgp_repeated_var": (
        "SELECT ?s ?k WHERE { ?s t:s_suppkey ?k ; t:s_nationkey ?k }",
        "SELECT 'urn:data:supplier/' || s_suppkey AS s, s_suppkey AS k FROM supplier WHERE s_suppkey=s_nationkey",
    ),
    "bgp_cross": (
        "SELECT ?a ?b WHERE { ?x t:r_name ?a . ?y t:n_name ?b }",
        "SELECT r_name AS a, n_name AS b FROM region, nation",
    ),
    "bgp_constant_subject": (
        "SELECT ?name ?nat WHERE { <urn:data:customer/7> t:c_name ?name ; t:inNation ?nat }",
        "SELECT c_name AS name, 'urn:data:nation/' || c_nationkey AS nat FROM customer WHERE c_custkey=7",
    ),
    "bgp_blank_nodes": (
        'SELECT DISTINCT ?name WHERE { ?c t:c_name ?name ; t:placed [ t:o_orderstatus "P" ; t:o_orderpriority "1-URGENT" ] }',
        "SELECT DISTINCT c_name AS name FROM customer JOIN orders ON o_custkey=c_custkey WHERE o_orderstatus='P' AND o_orderpriority='1-URGENT'",
    ),
    "filter_num": (
        "SELECT ?k ?p WHERE { ?x t:p_partkey ?k ; t:p_retailprice ?p ; t:p_size ?z FILTER(?p * 2 > 2500 && ?z - 10 < 5 || ?z = 50) }",
        "SELECT p_partkey AS k, p_retailprice AS p FROM part WHERE (p_retailprice*2>2500 AND p_size-10<5) OR p_size=50",
    ),
    "filter_regex": (
        'SELECT ?k ?up ?pre WHERE { ?p t:p_partkey ?k ; t:p_brand ?b FILTER REGEX(?b, "^brand#1", "i") BIND(UCASE(?b) AS ?up) BIND(STRBEFORE(?b, "#") AS ?pre) }',
        "SELECT p_partkey AS k, upper(p_brand) AS up, CASE WHEN strpos(p_brand,'#')>0 THEN split_part(p_brand,'#',1) ELSE '' END AS pre FROM part WHERE regexp_matches(p_brand,'^brand#1','i')",
    ),
    "filter_in": (
        'SELECT ?e WHERE { ?e t:event_type ?t ; t:value ?v FILTER(?t IN ("purchase", "error") && ?v NOT IN (1, 2)) }',
        "SELECT 'urn:data:events/' || event_id AS e FROM events WHERE event_type IN ('purchase','error') AND value NOT IN (1,2)",
    ),
    "filter_error_false": (
        "SELECT ?k WHERE { ?p t:p_partkey ?k ; t:p_name ?n ; t:p_size ?z FILTER(?n > 3 || ?z < 10) }",
        "SELECT p_partkey AS k FROM part WHERE p_size<10",
    ),
    "filter_logic": (
        "SELECT ?k WHERE { ?o t:o_orderkey ?k ; t:o_totalprice ?p ; t:o_orderstatus ?s FILTER(!(?s = 'F') && (?p < 50000 || !BOUND(?zzz) && ?p > 300000)) }",
        "SELECT o_orderkey AS k FROM orders WHERE NOT o_orderstatus='F' AND (o_totalprice<50000 OR o_totalprice>300000)",
    ),
    "filter_date": (
        'SELECT ?k ?y ?m ?d WHERE { ?o t:o_orderkey ?k ; t:o_orderdate ?t FILTER(?t >= "1996-03-01T00:00:00"^^xsd:dateTime && MONTH(?t) < 7) BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) AS ?d) }',
        "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders WHERE o_orderdate>=TIMESTAMP '1996-03-01' AND month(o_orderdate)<7",
    ),
    "time_funcs": (
        "SELECT ?e ?h ?mi ?s WHERE { ?x t:event_id ?e ; t:ts ?t BIND(HOURS(?t) AS ?h) BIND(MINUTES(?t) AS ?mi) BIND(FLOOR(SECONDS(?t)) AS ?s) }",
        "SELECT event_id AS e, hour(ts) AS h, minute(ts) AS mi, second(ts)::DOUBLE AS s FROM events",
    ),
    "bound_coalesce_if": (
        'SELECT ?k ?q ?c WHERE { ?o t:o_orderkey ?k OPTIONAL { ?l t:ofOrder ?o ; t:l_quantity ?lq FILTER(?lq > 49) } BIND(COALESCE(?lq, -1.0) AS ?q) BIND(IF(BOUND(?lq), "big", "none") AS ?c) }',
        "SELECT o_orderkey AS k, coalesce(l_quantity, -1.0) AS q, CASE WHEN l_quantity IS NOT NULL THEN 'big' ELSE 'none' END AS c FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey AND l_quantity>49",
    ),
    "str_funcs": (
        'SELECT ?k ?l ?s ?a ?c ?e ?r ?u WHERE { ?p t:p_partkey ?k ; t:p_brand ?b ; t:p_type ?y BIND(STRLEN(?y) AS ?l) BIND(SUBSTR(?y, 2, 4) AS ?s) BIND(STRAFTER(?b, "#") AS ?a) BIND(CONCAT(LCASE(?b), "/", ?y) AS ?c) BIND(ENCODE_FOR_URI(?b) AS ?e) BIND(REPLACE(?y, "[AEIOU]", "_") AS ?r) BIND(STRSTARTS(?y, "S") && STRENDS(?y, "D") || CONTAINS(?y, "PL") AS ?u) }',
        "SELECT p_partkey AS k, length(p_type) AS l, substr(p_type,2,4) AS s, CASE WHEN strpos(p_brand,'#')>0 THEN substr(p_brand, strpos(p_brand,'#')+1) ELSE '' END AS a, lower(p_brand) || '/' || p_type AS c, replace(replace(p_brand,'#','%23'),' ','%20') AS e, regexp_replace(p_type,'[AEIOU]','_','g') AS r, (starts_with(p_type,'S') AND ends_with(p_type,'D')) OR contains(p_type,'PL') AS u FROM part",
    ),
    "num_funcs": (
        "SELECT ?k ?r ?c ?f ?a ?q WHERE { ?x t:c_custkey ?k ; t:c_acctbal ?b BIND(ROUND(?b) AS ?r) BIND(CEIL(?b) AS ?c) BIND(FLOOR(?b) AS ?f) BIND(ABS(-?b) AS ?a) BIND(?k / 4 AS ?q) }",
        "SELECT c_custkey AS k, floor(c_acctbal+0.5) AS r, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, abs(-c_acctbal) AS a, c_custkey/4.0::DOUBLE AS q FROM customer",
    ),
    "hash_funcs": (
        "SELECT ?m ?h ?h1 WHERE { ?x t:n_name ?n BIND(MD5(?n) AS ?m) BIND(SHA256(?n) AS ?h) BIND(SHA1(?n) AS ?h1) }",
        "SELECT md5(n_name) AS m, sha256(n_name) AS h, sha1(n_name) AS h1 FROM nation",
    ),
    "cast_funcs": (
        'SELECT ?k ?i ?d ?s ?b WHERE { ?x t:n_nationkey ?k ; t:n_name ?n BIND(xsd:integer(STRAFTER(?n, "_")) AS ?i) BIND(xsd:double(?k) AS ?d) BIND(xsd:string(?k) AS ?s) BIND(xsd:boolean(?k) AS ?b) }',
        "SELECT n_nationkey::BIGINT AS k, try_cast(split_part(n_name,'_',2) AS BIGINT) AS i, n_nationkey::DOUBLE AS d, n_nationkey::VARCHAR AS s, n_nationkey<>0 AS b FROM nation",
    ),
    "term_tests": (
        'SELECT ?k ?a ?b ?c ?d ?e WHERE { ?x t:n_nationkey ?k ; t:inRegion ?r BIND(isIRI(?r) AS ?a) BIND(isLITERAL(?k) AS ?b) BIND(isNUMERIC(?k) AS ?c) BIND(STR(?r) AS ?d) BIND(DATATYPE(?k) = xsd:integer && LANG("x"@en) = "en" && langMatches("de-AT", "de") && sameTerm(?r, ?r) AS ?e) }',
        "SELECT n_nationkey::BIGINT AS k, true AS a, true AS b, true AS c, 'urn:data:region/' || n_regionkey AS d, true AS e FROM nation",
    ),
    "optional_left": (
        "SELECT ?name ?k WHERE { ?c t:c_name ?name OPTIONAL { ?o t:placedBy ?c ; t:o_orderkey ?k ; t:o_orderpriority '5-LOW' } }",
        "SELECT c_name AS name, o_orderkey AS k FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority='5-LOW') ON o_custkey=c_custkey",
    ),
    "optional_filter_in_on": (
        "SELECT ?k ?q WHERE { ?o a t:Order ; t:o_orderkey ?k OPTIONAL { ?l t:ofOrder ?o ; t:l_quantity ?q FILTER(?q >= 45) } }",
        "SELECT o_orderkey AS k, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey AND l_quantity>=45",
    ),
    "optional_outer_filter": (
        "SELECT ?ok ?lq WHERE { ?o t:o_orderkey ?ok ; t:o_totalprice ?tp OPTIONAL { ?l t:ofOrder ?o ; t:l_quantity ?lq ; t:l_extendedprice ?ep FILTER(?ep > ?tp / 2) } }",
        "SELECT o_orderkey AS ok, l_quantity AS lq FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey AND l_extendedprice>o_totalprice/2",
    ),
    "optional_nested": (
        "SELECT ?c ?o ?q WHERE { ?x t:c_custkey ?c OPTIONAL { ?y t:placedBy ?x ; t:o_orderkey ?o ; t:o_orderstatus 'P' OPTIONAL { ?l t:ofOrder ?y ; t:l_quantity ?q FILTER(?q > 48) } } }",
        "SELECT c_custkey AS c, o_orderkey AS o, l_quantity AS q FROM customer LEFT JOIN (SELECT * FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey AND l_quantity>48 WHERE o_orderstatus='P') ON o_custkey=c_custkey",
    ),
    "join_maybe_unbound": (
        "SELECT ?n ?k WHERE { { SELECT ?n ?k { ?x t:n_name ?n OPTIONAL { ?x t:n_nationkey ?k FILTER(?k < 3) } } } { SELECT ?k { ?y t:r_regionkey ?k } } }",
        "SELECT n_name AS n, coalesce(CASE WHEN n_nationkey<3 THEN n_nationkey END, r_regionkey)::BIGINT AS k FROM nation JOIN region ON (n_nationkey>=3 OR n_nationkey=r_regionkey)",
    ),
    "union_all": (
        "SELECT ?n ?b WHERE { { ?x t:c_name ?n ; t:c_acctbal ?b FILTER(?b > 9000) } UNION { ?x t:s_name ?n ; t:s_acctbal ?b } }",
        "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_acctbal>9000 UNION ALL SELECT s_name, s_acctbal FROM supplier",
    ),
    "union_different_vars": (
        "SELECT ?a ?b WHERE { { ?x t:r_name ?a } UNION { ?y t:n_name ?b } }",
        "SELECT r_name AS a, NULL::VARCHAR AS b FROM region UNION ALL SELECT NULL, n_name FROM nation",
    ),
    "minus_shared": (
        "SELECT ?k WHERE { ?o t:o_orderkey ?k MINUS { ?l t:ofOrder ?o } }",
        "SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey)",
    ),
    "minus_disjoint": (
        "SELECT ?n WHERE { ?x t:n_name ?n MINUS { ?y t:r_name ?z } }",
        "SELECT n_name AS n FROM nation",
    ),
    "exists": (
        "SELECT ?k WHERE { ?o t:o_orderkey ?k FILTER EXISTS { ?l t:ofOrder ?o ; t:l_returnflag 'R' } }",
        "SELECT o_orderkey AS k FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_returnflag='R')",
    ),
    "not_exists": (
        'SELECT DISTINCT ?u WHERE { ?e t:byUser ?u ; t:event_type "purchase" FILTER NOT EXISTS { ?f t:byUser ?u ; t:event_type "error" ; t:value ?v FILTER(?v > 300) } }',
        "SELECT DISTINCT 'urn:tables#User/' || user_id AS u FROM events e WHERE event_type='purchase' AND NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id=e.user_id AND f.event_type='error' AND f.value>300)",
    ),
    "exists_correlated_nested": (
        "SELECT ?k WHERE { ?o t:o_orderkey ?k ; t:o_totalprice ?p FILTER(?p > 400000 || EXISTS { ?l t:ofOrder ?o ; t:l_extendedprice ?e FILTER(?e > ?p * 0.9) }) }",
        "SELECT o_orderkey AS k FROM orders WHERE o_totalprice>400000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_extendedprice>o_totalprice*0.9::DOUBLE)",
    ),
    "values_inline": (
        'SELECT ?k ?seg WHERE { ?c t:c_custkey ?k ; t:c_mktsegment ?seg VALUES ?seg { "BUILDING" "MACHINERY" } }',
        "SELECT c_custkey AS k, c_mktsegment AS seg FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY')",
    ),
    "values_undef": (
        'SELECT ?k ?st ?pr WHERE { ?o t:o_orderkey ?k ; t:o_orderstatus ?st ; t:o_orderpriority ?pr VALUES (?st ?pr) { ("F" UNDEF) (UNDEF "1-URGENT") } }',
        "SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr FROM orders JOIN (VALUES ('F',NULL),(NULL,'1-URGENT')) v(st,pr) ON (v.st IS NULL OR v.st=o_orderstatus) AND (v.pr IS NULL OR v.pr=o_orderpriority)",
    ),
    "bind_expr": (
        "SELECT ?k ?net WHERE { ?l t:l_linenumber ?k ; t:l_extendedprice ?p ; t:l_discount ?d BIND(?p * (1 - ?d) AS ?net) FILTER(?net > 90000) }",
        "SELECT l_linenumber::BIGINT AS k, l_extendedprice*(1-l_discount) AS net FROM lineitem WHERE l_extendedprice*(1-l_discount)>90000",
    ),
    "bind_error_unbound": (
        "SELECT ?k ?x WHERE { ?n t:n_nationkey ?k ; t:n_name ?m BIND(?m + 1 AS ?x) }",
        "SELECT n_nationkey::BIGINT AS k, NULL::DOUBLE AS x FROM nation",
    ),
    "select_expression": (
        "SELECT ?k (?b * 2 AS ?twice) (CONCAT(?n, '!') AS ?m) WHERE { ?s t:s_suppkey ?k ; t:s_acctbal ?b ; t:s_name ?n }",
        "SELECT s_suppkey AS k, s_acctbal*2 AS twice, s_name || '!' AS m FROM supplier",
    ),
    "subselect_topk": (
        "SELECT ?name ?p WHERE { { SELECT ?c ?p { ?o t:placedBy ?c ; t:o_totalprice ?p ; t:o_orderkey ?k } ORDER BY DESC(?p) ?k LIMIT 20 } ?c t:c_name ?name }",
        "SELECT c_name AS name, p FROM (SELECT o_custkey, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) JOIN customer ON o_custkey=c_custkey",
    ),
    "distinct_vars": (
        "SELECT DISTINCT ?st ?pr WHERE { ?o t:o_orderstatus ?st ; t:o_orderpriority ?pr }",
        "SELECT DISTINCT o_orderstatus AS st, o_orderpriority AS pr FROM orders",
    ),
    "reduced_vars": (
        "SELECT REDUCED ?n WHERE { ?x t:n_name ?n }",
        "SELECT n_name AS n FROM nation",
    ),
    "order_limit_offset": (
        "SELECT ?k ?price WHERE { ?o t:o_orderkey ?k ; t:o_totalprice ?price } ORDER BY DESC(?price) ?k LIMIT 25 OFFSET 5",
        "SELECT o_orderkey AS k, o_totalprice AS price FROM orders ORDER BY price DESC, k LIMIT 25 OFFSET 5",
    ),
    "order_kinds": (
        "SELECT ?n ?k WHERE { ?x t:n_name ?n OPTIONAL { ?x t:n_nationkey ?k FILTER(?k > 20) } } ORDER BY DESC(?k) ?n LIMIT 7",
        "SELECT n_name AS n, CASE WHEN n_nationkey>20 THEN n_nationkey END::BIGINT AS k FROM nation ORDER BY k DESC NULLS LAST, n LIMIT 7",
    ),
    "ask_true": ('ASK { ?r t:r_name "ASIA" }', "SELECT count(*)>0 AS answer FROM region WHERE r_name='ASIA'"),
    "ask_false": ('ASK { ?r t:r_name "ATLANTIS" }', "SELECT count(*)>0 AS answer FROM region WHERE r_name='ATLANTIS'"),
    "agg_group": (
        "SELECT ?flag ?status (SUM(?q) AS ?sum_qty) (COUNT(*) AS ?n) (MIN(?d) AS ?lo) (MAX(?d) AS ?hi) WHERE { ?l t:l_returnflag ?flag ; t:l_linestatus ?status ; t:l_quantity ?q ; t:l_discount ?d } GROUP BY ?flag ?status",
        "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS sum_qty, count(*) AS n, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY 1,2",
    ),
    "agg_expression_key": (
        "SELECT ?y (COUNT(?o) AS ?n) (ROUND(AVG(?k)) AS ?m) WHERE { ?o t:o_orderdate ?d ; t:o_orderkey ?k } GROUP BY (YEAR(?d) AS ?y)",
        "SELECT year(o_orderdate) AS y, count(*) AS n, floor(avg(o_orderkey)+0.5) AS m FROM orders GROUP BY 1",
    ),
    "agg_global_empty": (
        "SELECT (COUNT(?x) AS ?n) (SUM(?b) AS ?s) (AVG(?b) AS ?a) (MIN(?b) AS ?m) WHERE { ?x t:c_acctbal ?b FILTER(?b > 1e9) }",
        "SELECT count(*) AS n, 0.0::DOUBLE AS s, 0.0::DOUBLE AS a, NULL::DOUBLE AS m FROM customer WHERE c_acctbal>1e9",
    ),
    "agg_distinct": (
        "SELECT ?seg (COUNT(DISTINCT ?n) AS ?k) (SUM(DISTINCT ?n) AS ?s) WHERE { ?c t:c_mktsegment ?seg ; t:c_nationkey ?n } GROUP BY ?seg",
        "SELECT c_mktsegment AS seg, count(DISTINCT c_nationkey) AS k, sum(DISTINCT c_nationkey)::BIGINT AS s FROM customer GROUP BY 1",
    ),
    "agg_count_distinct_all": (
        "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { ?l t:l_returnflag ?flag ; t:l_linestatus ?status ; t:l_linenumber ?k }",
        "SELECT count(*) AS n FROM lineitem",
    ),
    "agg_having": (
        "SELECT ?seg (COUNT(?c) AS ?n) (MIN(?b) AS ?lo) (MAX(?b) AS ?hi) WHERE { ?c t:c_mktsegment ?seg ; t:c_acctbal ?b } GROUP BY ?seg HAVING (COUNT(?c) > 300)",
        "SELECT c_mktsegment AS seg, count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1 HAVING count(*)>300",
    ),
    "agg_concat": (
        'SELECT ?r (GROUP_CONCAT(?n ; SEPARATOR = ", ") AS ?names) WHERE { ?x t:n_name ?n ; t:inRegion ?y . ?y t:r_name ?r } GROUP BY ?r',
        "SELECT r_name AS r, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1",
    ),
    "agg_minmax": (
        "SELECT ?t (MIN(?n) AS ?a) (MAX(?x) AS ?b) (SAMPLE(?t2) AS ?c) WHERE { ?x t:p_type ?t ; t:p_name ?n ; t:p_type ?t2 } GROUP BY ?t",
        "SELECT p_type AS t, min(p_name) AS a, max('urn:data:part/' || p_partkey) AS b, p_type AS c FROM part GROUP BY 1",
    ),
    "inverse_follow": (
        "SELECT ?r ?n WHERE { ?x t:r_name ?r ; t:hasNation ?y . ?y t:n_name ?n }",
        "SELECT r_name AS r, n_name AS n FROM region JOIN nation ON n_regionkey=r_regionkey",
    ),
    "path_chain": (
        "SELECT ?k ?r WHERE { ?o t:o_orderkey ?k ; t:placedBy/t:inNation/t:inRegion/t:r_name ?r . ?o ^t:ofOrder ?l . ?l t:l_quantity 50 }",
        "SELECT o_orderkey AS k, r_name AS r FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey JOIN lineitem ON l_orderkey=o_orderkey WHERE l_quantity=50",
    ),
    "subclass_type": (
        "SELECT ?nk (COUNT(*) AS ?n) WHERE { ?x a t:Party ; t:inNation ?nat . ?nat t:n_nationkey ?nk } GROUP BY ?nk",
        "SELECT nk::BIGINT AS nk, count(*) AS n FROM (SELECT c_nationkey AS nk FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY nk",
    ),
    "type_variable": (
        "SELECT ?type (COUNT(*) AS ?n) WHERE { ?x a ?type ; t:inNation ?nat } GROUP BY ?type",
        "SELECT 'urn:tables#Customer' AS type, count(*) AS n FROM customer UNION ALL SELECT 'urn:tables#Supplier', count(*) FROM supplier",
    ),
    "documents_by_language": (
        "SELECT ?lang ?src (COUNT(*) AS ?n) (SUM(?c) AS ?chars) WHERE { ?d t:lang ?lang ; t:source ?src ; t:n_chars ?c } GROUP BY ?lang ?src",
        "SELECT lang, source AS src, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1,2",
    ),
    "label_join": (
        "SELECT ?lang ?q (COUNT(*) AS ?n) WHERE { ?l t:about ?d ; t:quality ?q . ?d t:lang ?lang } GROUP BY ?lang ?q",
        "SELECT lang, quality::BIGINT AS q, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1,2",
    ),
    "turn_pairs": (
        'SELECT ?conv ?t WHERE { ?b t:follows ?a ; t:role "assistant" ; t:conv_id ?conv ; t:turn ?t . ?a t:role "user" }',
        "SELECT b.conv_id AS conv, b.turn AS t FROM conversations b JOIN conversations a ON a.conv_id=b.conv_id AND a.turn=b.turn-1 WHERE b.role='assistant' AND a.role='user'",
    ),
    "optional_maybe_unbound": (
        "SELECT ?k ?c ?n WHERE { ?o t:o_orderkey ?k FILTER(?k < 100) OPTIONAL { ?o t:placedBy ?c . ?c t:c_acctbal ?b FILTER(?b > 5000) } OPTIONAL { ?c t:c_name ?n ; t:c_mktsegment 'BUILDING' } }",
        "WITH x AS (SELECT o_orderkey, c_custkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey=c_custkey WHERE o_orderkey < 100), b AS (SELECT * FROM customer WHERE c_mktsegment='BUILDING')"
        " SELECT o_orderkey AS k, 'urn:data:customer/' || b.c_custkey AS c, c_name AS n FROM x JOIN b ON x.c_custkey IS NULL OR x.c_custkey=b.c_custkey"
        " UNION ALL SELECT o_orderkey, 'urn:data:customer/' || c_custkey, NULL FROM x WHERE c_custkey IS NOT NULL AND c_custkey NOT IN (SELECT c_custkey FROM b)"
        " UNION ALL SELECT o_orderkey, NULL, NULL FROM x WHERE c_custkey IS NULL AND NOT EXISTS (FROM b)",
    ),
    "minus_maybe_unbound": (
        "SELECT ?k WHERE { ?o t:o_orderkey ?k OPTIONAL { ?o t:placedBy ?c . ?c t:c_acctbal ?b FILTER(?b > 5000) } MINUS { ?c t:c_mktsegment 'BUILDING' } }",
        "SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey=c_custkey WHERE NOT (c_acctbal > 5000 AND c_mktsegment='BUILDING')",
    ),
    "exists_maybe_unbound": (
        "SELECT ?k WHERE { ?o t:o_orderkey ?k OPTIONAL { ?o t:placedBy ?c . ?c t:c_acctbal ?b FILTER(?b > 5000) } FILTER EXISTS { ?c t:c_mktsegment 'BUILDING' } }",
        "SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey=c_custkey WHERE CASE WHEN c_acctbal > 5000 THEN c_mktsegment='BUILDING' ELSE EXISTS (FROM customer WHERE c_mktsegment='BUILDING') END",
    ),
    "not_exists_maybe_unbound": (
        "SELECT ?k WHERE { ?o t:o_orderkey ?k OPTIONAL { ?o t:placedBy ?c . ?c t:c_acctbal ?b FILTER(?b > 5000) } FILTER NOT EXISTS { ?c t:c_mktsegment 'BUILDING' } }",
        "SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey=c_custkey WHERE CASE WHEN c_acctbal > 5000 THEN c_mktsegment<>'BUILDING' ELSE NOT EXISTS (FROM customer WHERE c_mktsegment='BUILDING') END",
    ),
    "optional_exists_filter": (
        "SELECT ?k ?seg WHERE { ?c t:c_custkey ?k ; t:inNation ?n OPTIONAL { ?c t:c_mktsegment ?seg FILTER(EXISTS { ?s t:inNation ?n ; t:s_acctbal ?a FILTER(?a > 5000) }) } }",
        "SELECT c_custkey AS k, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) THEN c_mktsegment END AS seg FROM customer",
    ),
    "optional_not_exists_or": (
        "SELECT ?k ?seg WHERE { ?c t:c_custkey ?k OPTIONAL { ?c t:c_mktsegment ?seg ; t:c_acctbal ?b FILTER(?b < 0 || NOT EXISTS { ?o t:placedBy ?c ; t:o_orderstatus 'P' }) } }",
        "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 OR c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P') THEN c_mktsegment END AS seg FROM customer",
    ),
}


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tables.session(spark, sf_dir).sparql(text)


def union_ref_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "SELECT ?nk WHERE { { SELECT ?nk { ?c a t:Customer ; t:c_nationkey ?nk ; t:c_acctbal ?b FILTER(?b > 9800) } } UNION { SELECT ?nk { ?s a t:Supplier ; t:s_nationkey ?nk } } }"
    return tables.session(spark, sf_dir).sparql(q, semantics="reference")


def agg_reference_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "SELECT ?n (COUNT(?x) AS ?c) WHERE { ?x t:n_name ?n FILTER(?n = 'none') } GROUP BY ?n"
    return tables.session(spark, sf_dir).sparql(q, semantics="reference")


def join_reference_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "SELECT ?k ?st WHERE { ?n t:n_nationkey ?k { SELECT ?k ?st { ?c t:c_nationkey ?k ; t:c_mktsegment ?st } } }"
    return tables.session(spark, sf_dir).sparql(q, semantics="reference")


def init_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.session(spark, sf_dir).sparql("SELECT ?name ?seg WHERE { ?c t:c_name ?name ; t:c_mktsegment ?seg }", bindings={"seg": Literal("MACHINERY")})


def _text(df: DataFrame) -> DataFrame:
    """Triples as text."""
    return df.select(n3(F.col("s")).alias("s"), (n3(F.col("p")) if dict(df.dtypes)["p"] != "string" else F.col("p")).alias("p"), n3(F.col("o")).alias("o"))


def construct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "CONSTRUCT { ?r t:contains ?n . ?n t:label ?name } WHERE { ?n t:inRegion ?r ; t:n_name ?name }"
    return _text(tables.session(spark, sf_dir).sparql(q))


def construct_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(tables.session(spark, sf_dir).sparql("CONSTRUCT WHERE { ?n t:inRegion ?r }"))


def custom_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.session(spark, sf_dir)
    s.functions["urn:f#reverse"] = F.reverse
    return s.sparql("SELECT ?n (<urn:f#reverse>(?n) AS ?back) WHERE { ?x t:n_name ?n }")


def _places(spark: SparkSession, sf_dir: str):
    """Regions and nations as loaded triples, a graph for each class."""
    from graphloom.session import Session
    from graphloom.sources.mapping import triples_of
    from graphloom.sources.triples import TripleStore

    store = TripleStore(triples_of(tables.mapping(spark, sf_dir), [NS + "Region", NS + "Nation"]), disjoint=True)
    return Session(spark, store, prefixes=dict(tables.PREFIXES))


def graph_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).sparql("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")


def graph_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).sparql("SELECT ?name WHERE { GRAPH t:Region { ?s t:r_name ?name } }")


def graph_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).sparql("SELECT (COUNT(*) AS ?n) FROM t:Nation WHERE { ?s ?p ?o }")


def triples_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).sparql('SELECT ?n ?k WHERE { ?x t:inRegion ?r ; t:n_name ?n ; t:n_nationkey ?k . ?r t:r_name "EUROPE" FILTER(?k > 3) } ORDER BY ?k')


def variable_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).sparql("SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p")


# Vocabulary


def _shown(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    df = tables.session(spark, sf_dir).vocab.frame(spark, what)
    return df.select(*(F.replace(c, F.lit(NS), F.lit("")).alias(c) for c in df.columns))


#: What follows from the tables' ontology, written out: links with the classes at their ends, subclasses of Party included.
_EDGES = """Nation inRegion Region, Region hasNation Nation, Order placedBy Customer, Customer placed Order, LineItem ofOrder Order, Order hasItem LineItem, LineItem ofPart Part, Part partOf LineItem,
LineItem suppliedBy Supplier, Supplier supplies LineItem, Event byUser User, User triggered Event, Turn follows Turn, Turn followedBy Turn, Label about Document,
Party inNation Nation, Customer inNation Nation, Supplier inNation Nation, Nation hasParty Party, Nation hasParty Customer, Nation hasParty Supplier"""
_COLUMNS = """Region r_regionkey, Region r_name, Nation n_nationkey, Nation n_name, Customer c_custkey, Customer c_name, Customer c_nationkey, Customer c_acctbal, Customer c_mktsegment, Supplier s_suppkey, Supplier s_name,
Supplier s_nationkey, Supplier s_acctbal, Part p_partkey, Part p_name, Part p_brand, Part p_type, Part p_size, Part p_retailprice, Order o_orderkey, Order o_orderstatus, Order o_totalprice, Order o_orderdate,
Order o_orderpriority, LineItem l_linenumber, LineItem l_quantity, LineItem l_extendedprice, LineItem l_discount, LineItem l_tax, LineItem l_returnflag, LineItem l_linestatus, LineItem l_shipdate, Event event_id, Event ts,
Event event_type, Event value, Event props, Document doc_id, Document text, Document lang, Document source, Document n_chars, Label quality, Label toxic, Page page_id, Page url, Page html, Turn conv_id, Turn turn, Turn role,
Turn text, Item item_id, Item text, Vector vec_id, Vector label"""
_SPLIT_EDGES = f"SELECT string_split(trim(unnest(string_split(replace('{_EDGES}', chr(10), ' '), ','))), ' ') AS e"
_SPLIT_COLUMNS = f"SELECT string_split(trim(unnest(string_split(replace('{_COLUMNS}', chr(10), ' '), ','))), ' ') AS e"
_CYCLES = f"""WITH RECURSIVE e AS (SELECT e[1] AS a, e[2] AS p, e[3] AS b FROM ({_SPLIT_EDGES})),
w(start, here, seen, cycle, closed) AS (
  SELECT a, b, [a], p, a = b FROM e WHERE b >= a
  UNION ALL
  SELECT start, e.b, list_append(seen, here), cycle || ' ' || p, e.b = start FROM w JOIN e ON e.a = here WHERE NOT closed AND e.b >= start AND NOT list_contains(seen[2:], e.b) AND e.b <> here
) SELECT cycle FROM w WHERE closed"""


def vocab_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir, "types")


def vocab_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir, "domains")


def vocab_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir, "ranges")


def vocab_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir, "closure").select(F.col("class"), F.col("super"))


def vocab_inverses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir, "inverses")


def vocab_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.paths import Navigator

    s = tables.session(spark, sf_dir, {"Region": [f"{DATA}region/2"]})
    rows = [(" ".join(f"{t.removeprefix(NS)}.{p.removeprefix(NS)}" for t, p in x.steps), len(x.seeds)) for x in Navigator(s.vocab).paths(NS + "Order")]
    return spark.createDataFrame(rows, "path string, seeds int")


def vocab_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.paths import Navigator

    s = tables.session(spark, sf_dir)
    rows = [(" ".join(p.removeprefix(NS) for _, p in c),) for c in Navigator(s.vocab).cycles()]
    return spark.createDataFrame(rows, "cycle string")


def seed_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = [r[0] for r in spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit(f"{DATA}region/"), "r_regionkey")).collect()]
    s = tables.session(spark, sf_dir, {"Region": seeds})
    return spark.createDataFrame([("Region", s.vocab.seeds.digest(NS + "Region"))], "type string, digest string")


# Reachability and fragments


def reach_seed_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.session(spark, sf_dir, {"Region": [f"{DATA}region/2"]})
    return s.sparql('SELECT ?k WHERE { ?o t:placedBy ?c ; t:o_orderkey ?k . ?c t:c_mktsegment "BUILDING" . ?c t:inNation ?n . ?n t:inRegion <urn:data:region/2> }', scope="reachable")


def reach_seed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.traversal import Traversal
    from graphloom.plans.planner import Tree
    from graphloom.functions.terms import Var

    s = tables.session(spark, sf_dir)
    steps = tuple((NS + a, NS + b) for a, b in (("Region", "hasNation"), ("Nation", "hasParty"), ("Customer", "placed")))
    t = Traversal(spark, s.data, s.vocab)
    at = t.reach(Tree(NS + "Region", (f"{DATA}region/2",), steps, Var("o"), (), 3))
    return at.df.select(F.col("v_at").cast("long").alias("k"))


def reach_fixpoint_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the last turn of every conversation along ``follows`` until nothing new is reached."""
    from graphloom.operators.solutions import Solutions
    from graphloom.operators.traversal import Traversal
    from graphloom.functions.values import Kind

    s = tables.session(spark, sf_dir)
    last = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    prefix = s.data.classes[NS + "Turn"].prefix
    seeds = Solutions(last.select(F.concat("conv_id", F.lit("_"), "turn").alias("v_at")), {"at": Kind("iri", prefix)})
    found = Traversal(spark, s.data, s.vocab).fixpoint(seeds, [NS + "follows"])
    part = F.split("v_at", "_")
    return found.df.select(part[0].cast("long").alias("conv"), part[1].cast("long").alias("turn"))


def reach_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties of one region's nations where a pattern expects customers; suppliers stand in the same place."""
    from graphloom.operators.traversal import Traversal

    s = tables.session(spark, sf_dir, {"Region": [f"{DATA}region/2"]})
    space = s.search_plan("SELECT * WHERE { ?c t:inNation ?n ; t:c_acctbal ?b }")[0].spaces[0]
    trees = [replace(t, cycles=()) for t in space.trees if [p for _, p in t.steps] == [NS + "hasNation", NS + "hasParty"]]
    found = Traversal(spark, s.data, s.vocab).reach(*trees, types=space.types[trees[0].root])
    return found.df.select(F.replace(V.lexical(found.col("at"), found.kinds["at"]), F.lit(DATA), F.lit("")).alias("c"))


def fragment_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one pattern collected answers another one, which no seed reaches by itself."""
    s = tables.session(spark, sf_dir, {"Label": [f"{DATA}labels/1"]})
    query = """SELECT ?x (xsd:double(?b) AS ?bal) ?w WHERE {
      { <urn:data:region/2> t:hasNation ?n . ?n t:hasParty ?c . ?c t:c_name ?x ; t:c_acctbal ?b BIND("own" AS ?w) } UNION { ?d t:c_acctbal ?b ; t:c_name ?x BIND("collected" AS ?w) } }"""
    return s.sparql(query, scope="fragment")


_FRAGMENT = '{ ?o t:placedBy ?c . ?c t:c_mktsegment "BUILDING" }'


def _short(quads: DataFrame) -> DataFrame:
    return quads.select("tp", F.replace("s.lex", F.lit(DATA), F.lit("")).alias("s"), F.replace("o.lex", F.lit(DATA), F.lit("")).alias("o"))


def fragment_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(_everywhere(spark, sf_dir).fragment_quads(f"SELECT * WHERE {_FRAGMENT}"))


def _everywhere(spark: SparkSession, sf_dir: str):
    """A session whose seeds are all regions, from which all nations, customers and orders are reached."""
    keys = [r[0] for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey").collect()]
    return tables.session(spark, sf_dir, {"Region": [f"{DATA}region/{k}" for k in keys]})


def fragment_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _everywhere(spark, sf_dir)
    return _short(s.fragment_quads("SELECT * WHERE { ?o t:placedBy ?c ; t:o_totalprice ?p . ?c t:c_acctbal ?b FILTER(?p > 300000) FILTER(?b < 0) }"))


def fragment_from_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and customers reached from one region."""
    s = tables.session(spark, sf_dir, {"Region": [f"{DATA}region/1"]})
    return _short(s.fragment_quads("SELECT * WHERE { ?r t:hasNation ?n . ?n t:n_name ?name }"))


def fragment_cached_generalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kept fragment of a general pattern answers a more special one."""
    from graphloom.sources.fragments import FragmentCache

    s = _everywhere(spark, sf_dir)
    s.cache = FragmentCache(spark)
    s.fragment_quads("SELECT * WHERE { ?a t:placedBy ?b . ?b t:c_mktsegment ?seg }")
    found = s.fragment_quads(f"SELECT * WHERE {_FRAGMENT}")
    if s.cache.hits != 1:
        raise RuntimeError("the kept fragment was not found")
    return _short(found)


def ttl_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of events taken as cached resources, those fresh at a given time, and the least expiry of each type."""
    from graphloom.sources.fragments import fresh

    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("expires_at", F.unix_timestamp("ts") + (F.col("event_id") % 1000) * 60)
    now = F.unix_timestamp(F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return fresh(df, now).groupBy("event_type").agg(F.count("*").alias("n"), F.min("expires_at").alias("ttl"))


def incremental_bgp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to a pattern over customers and orders whose triples arrive in six batches, by a stream."""
    from graphloom.plans.agp import parse_agp
    from graphloom.sources.mapping import triples_of
    from graphloom.sources.store import shared_dir
    from graphloom.streaming.incremental import IncrementalPattern

    base = f"{shared_dir(spark)}/incremental-{uuid.uuid4().hex}"
    triples = triples_of(tables.mapping(spark, sf_dir), [NS + "Order", NS + "Customer"]).withColumn("tp", F.lit("tp_0")).select("tp", "s", "p", "o")
    triples.repartition(6, F.xxhash64("s.lex", "p")).write.parquet(f"{base}/in")
    pattern = IncrementalPattern(spark, parse_agp("{ ?x t:placedBy ?c ; t:o_orderpriority ?p . ?c t:c_name ?n }", tables.PREFIXES), f"{base}/state")
    stream = spark.readStream.schema(triples.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    pattern.start(stream, f"{base}/checkpoint").awaitTermination()
    return pattern.answers().select("n", "p", "x")


TTL, REPLAYED = 21_600, 1_705_000_000


def live_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which user did what, told at most once in six hours: replayed up to an offset, then by a stream."""
    from graphloom.functions import terms as T
    from graphloom.sources.fragments import FragmentStream
    from graphloom.sources.store import shared_dir

    base = f"{shared_dir(spark)}/tail-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.unix_timestamp("ts").alias("ts"), F.col("user_id").cast("string").alias("u"), "event_type")
    quads = events.select(F.lit("tp_0").alias("tp"), T.make(T.IRI, F.concat(F.lit(f"{DATA}user/"), "u")).alias("s"), F.lit(NS + "did").alias("p"), T.make(T.LITERAL, F.col("event_type"), XSD + "string").alias("o"), "ts")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    kept = FragmentStream(spark, f"{base}/quads")
    for i in range(3):  # arrivals in order of time
        begin, end = (low + (high + 1 - low) * k // 3 for k in (i, i + 1))
        kept.append(quads.filter((F.col("ts") >= begin) & (F.col("ts") < end)))
    live = kept.tail(REPLAYED, TTL).writeStream.format("parquet").option("path", f"{base}/told").option("checkpointLocation", f"{base}/checkpoint")
    live.trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema(kept.SCHEMA).parquet(f"{base}/told").unionByName(kept.get(REPLAYED))
    return told.select(F.replace("s.lex", F.lit(f"{DATA}user/"), F.lit("")).cast("long").alias("user_id"), F.col("o.lex").alias("event_type"), "ts")


def sparql_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.plans.compiler import Compiler
    from graphloom.sources.results import json_rows

    return json_rows(Compiler(spark, tables.mapping(spark, sf_dir)), "SELECT ?r ?k ?n WHERE { ?r t:r_regionkey ?k ; t:r_name ?n }", tables.PREFIXES)


def quad_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.sources.results import parse_quads
    from graphloom.sources.results import quad_text as write

    lines = write(_everywhere(spark, sf_dir).fragment_quads("SELECT * WHERE { ?x t:inRegion ?y . ?y t:r_name ?z }"))
    return parse_quads(lines).select("tp", F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"))


def turtle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written as N-Triples files and read again in parallel."""
    from graphloom.sources.mapping import triples_of
    from graphloom.sources.store import shared_dir
    from graphloom.sources.turtle import read_ntriples

    df = triples_of(tables.mapping(spark, sf_dir), [NS + "Supplier"])
    path = f"{shared_dir(spark)}/triples-{uuid.uuid4().hex}"
    df.select(F.concat_ws(" ", n3(F.col("s")), F.concat(F.lit("<"), "p", F.lit(">")), n3(F.col("o")), F.lit("."))).write.text(path)
    return read_ntriples(spark, path).groupBy("p", F.col("o.dt").alias("dt")).agg(F.count("*").alias("n"), F.count_distinct("o.lex").alias("d"))


def plan_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search trees for a pattern, with the class they start from and their length."""
    s = tables.session(spark, sf_dir, {"Region": [f"{DATA}region/2"]})
    plan = s.search_plan('SELECT * WHERE { ?n t:n_name ?name ; t:hasParty ?c . ?c t:c_mktsegment "BUILDING" }')[0]
    rows = [(t.from_type.removeprefix(NS), " ".join(p.removeprefix(NS) for _, p in t.steps), t.length) for sp in plan.spaces for t in sp.trees]
    return spark.createDataFrame(rows, "from_type string, steps string, length int")


_NATION = f"SELECT 'tp_0' AS tp, 'region/' || r_regionkey AS s, 'nation/' || n_nationkey AS o FROM region JOIN nation ON n_regionkey=r_regionkey WHERE r_regionkey=1 UNION SELECT 'tp_1', 'nation/' || n_nationkey, n_name FROM nation WHERE n_regionkey=1"
_QUADS = "SELECT 'tp_0' AS tp, 'orders/' || o_orderkey AS s, 'customer/' || o_custkey AS o FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING') UNION SELECT 'tp_1', 'customer/' || c_custkey, c_mktsegment FROM customer WHERE c_mktsegment='BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders)"
_T = "urn:tables#"
_NATION_CONSTRUCT = f"SELECT '<urn:data:nation/' || n_nationkey || '>' AS s, '<{_T}inRegion>' AS p, '<urn:data:region/' || n_regionkey || '>' AS o FROM nation"

_CLOSURES = {
    "path_closure": (
        'SELECT ?a ?b WHERE { ?a t:role "assistant" ; t:follows+ ?b }',
        "WITH RECURSIVE r(a, c, t) AS (SELECT conv_id || '_' || turn, conv_id, turn - 1 FROM conversations WHERE role='assistant' AND turn>0 UNION SELECT r.a, x.conv_id, x.turn - 1 FROM r JOIN conversations x ON x.conv_id=r.c AND x.turn=r.t WHERE x.turn>0)"
        " SELECT 'urn:data:conversations/' || a AS a, 'urn:data:conversations/' || c || '_' || t AS b FROM r",
    ),
    "path_closure_backward": (
        "SELECT ?a ?b WHERE { ?a t:turn 1 . ?b t:follows* ?a }",
        "WITH RECURSIVE r(a, c, t) AS (SELECT conv_id || '_' || turn, conv_id, turn FROM conversations WHERE turn=1 UNION SELECT r.a, x.conv_id, x.turn FROM r JOIN conversations x ON x.conv_id=r.c AND x.turn=r.t+1)"
        " SELECT 'urn:data:conversations/' || a AS a, 'urn:data:conversations/' || c || '_' || t AS b FROM r",
    ),
    "path_alternatives": (
        "SELECT ?k ?r WHERE { ?x t:c_custkey ?k ; t:c_acctbal ?v ; t:inNation/(t:inRegion?|^t:inNation/t:inNation) ?r FILTER(?v < -900) }",
        "WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_acctbal < -900), o AS (SELECT k, 'urn:data:nation/' || n AS r FROM c UNION ALL SELECT k, 'urn:data:region/' || n_regionkey FROM c JOIN nation ON n_nationkey=n"
        " UNION ALL SELECT k, 'urn:data:nation/' || n FROM c JOIN (SELECT c_nationkey AS m FROM customer UNION ALL SELECT s_nationkey FROM supplier) ON m=n) SELECT k, r FROM o",
    ),
    "predicates_of_tables": (
        "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p",
        "SELECT p, sum(n)::BIGINT AS n FROM ("
        + " UNION ALL ".join(
            f"SELECT '{RDF_TYPE}' AS p, count(*) AS n FROM {table}"
            + "".join(f" UNION ALL SELECT '{NS}{c}', count({c}) FROM {table}" for c in columns.split())
            + "".join(f" UNION ALL SELECT '{NS}{link}', {'count(*) FILTER (turn > 0)' if link == 'follows' else f'count({key})'} FROM {table}" for link, (key, _) in links.items())
            for table, _, columns, links in tables._CLASSES.values()
        )
        + ") GROUP BY p",
    ),
    "predicates_to_resource": (
        "SELECT ?s ?p WHERE { ?s ?p <urn:data:nation/3> }",
        f"SELECT 'urn:data:customer/' || c_custkey AS s, '{NS}inNation' AS p FROM customer WHERE c_nationkey=3 UNION ALL SELECT 'urn:data:supplier/' || s_suppkey, '{NS}inNation' FROM supplier WHERE s_nationkey=3",
    ),
    "predicates_to_value": (
        'SELECT ?s ?p WHERE { ?s ?p "MACHINERY" }',
        f"SELECT 'urn:data:customer/' || c_custkey AS s, '{NS}c_mktsegment' AS p FROM customer WHERE c_mktsegment='MACHINERY'",
    ),
    "predicates_of_subject": (
        "SELECT ?k ?p ?o WHERE { ?n t:n_nationkey ?k ; ?p ?o FILTER(?k < 4) }",
        f"SELECT n_nationkey::BIGINT AS k, unnest(['{RDF_TYPE}', '{NS}n_nationkey', '{NS}n_name', '{NS}inRegion']) AS p, unnest(['{NS}Nation', n_nationkey::VARCHAR, n_name, 'urn:data:region/' || n_regionkey]) AS o FROM nation WHERE n_nationkey<4",
    ),
}
_TEXTS = {
    "concat_hot_group": (
        'SELECT ?hot (GROUP_CONCAT(DISTINCT STR(?p); SEPARATOR=",") AS ?prices) (COUNT(*) AS ?n) WHERE { ?l t:l_linenumber ?p ; t:l_returnflag ?f ; t:l_quantity ?q BIND(IF(?q > 5, "hot", ?f) AS ?hot) } GROUP BY ?hot',
        "SELECT CASE WHEN l_quantity > 5 THEN 'hot' ELSE l_returnflag END AS hot, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS prices, count(*) AS n FROM lineitem GROUP BY 1",
    ),
    "concat_long": (
        'SELECT ?s (GROUP_CONCAT(?k; SEPARATOR=" ") AS ?keys) WHERE { ?o t:o_orderstatus ?s ; t:o_orderkey ?k } GROUP BY ?s',
        "SELECT o_orderstatus AS s, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey::VARCHAR) AS keys FROM orders GROUP BY 1",
    ),
}
_DECIMALS = {
    "decimal_sums": (
        "SELECT ?f (STR(SUM(xsd:decimal(?p) * (1 - xsd:decimal(?d)) * (1 + xsd:decimal(?t)))) AS ?charge) (STR(SUM(xsd:decimal(?q)) / 8) AS ?eighth) (STR(MAX(xsd:decimal(?d) + 0.2)) AS ?high)"
        " WHERE { ?l t:l_returnflag ?f ; t:l_extendedprice ?p ; t:l_discount ?d ; t:l_tax ?t ; t:l_quantity ?q } GROUP BY ?f",
        "WITH x AS (SELECT l_returnflag AS f, sum(l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(4,2)) * (1 + l_tax::DECIMAL(4,2))) AS c, sum(l_quantity::DECIMAL(12,3)) * 0.125 AS e, max(l_discount::DECIMAL(4,2)) + 0.2 AS h FROM lineitem GROUP BY 1)"
        " SELECT f, regexp_replace(c::VARCHAR, '\\.?0+$', '') AS charge, regexp_replace(e::VARCHAR, '\\.?0+$', '') AS eighth, regexp_replace(h::VARCHAR, '\\.?0+$', '') AS high FROM x",
    ),
    "decimal_filter": (
        "SELECT ?k ?r WHERE { ?o t:o_orderkey ?k ; t:o_totalprice ?p BIND(xsd:decimal(?p) / 3 AS ?third) FILTER(?third * 3 = xsd:decimal(?p) && ?k / 7 * 7 = ?k) BIND(STR(FLOOR(?third)) AS ?r) }",
        "SELECT o_orderkey AS k, ((o_totalprice::DECIMAL(15,2) * 100)::BIGINT // 300)::VARCHAR AS r FROM orders WHERE (o_totalprice::DECIMAL(15,2) * 100)::BIGINT % 3 = 0 AND o_orderkey % 7 = 0",
    ),
}
SPARQL |= _CLOSURES | _TEXTS | _DECIMALS


def reach_event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first event along the next one's id: one chain as long as the table."""
    from graphloom.functions.values import Kind
    from graphloom.operators.solutions import Solutions
    from graphloom.operators.traversal import Traversal
    from graphloom.operators.vocabulary import Vocabulary
    from graphloom.sources.mapping import Mapping, TableClass

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = TableClass(NS + "Event", "events", "event_id", f"{DATA}events/", {}, {NS + "then": ("event_id + 1", NS + "Event")})
    kind = Kind("iri", own.prefix, True, "bigint")
    first = Solutions(events.agg(F.min("event_id").alias("v_at")), {"at": kind})
    found = Traversal(spark, Mapping({own.iri: own}, lambda _: events), Vocabulary()).fixpoint(first, [NS + "then"])
    return found.df.select(F.col("v_at").cast("long").alias("event_id"))


MORE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "union_ref_dedup": (union_ref_dedup, "SELECT c_nationkey::BIGINT AS nk FROM customer WHERE c_acctbal>9800 UNION ALL SELECT s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal>9800)"),
    "agg_reference_empty": (agg_reference_empty, "SELECT NULL::VARCHAR AS n, NULL::BIGINT AS c"),
    "join_reference_set": (join_reference_set, "SELECT DISTINCT n_nationkey::BIGINT AS k, c_mktsegment AS st FROM nation JOIN customer ON n_nationkey=c_nationkey"),
    "init_bindings": (init_bindings, "SELECT c_name AS name, c_mktsegment AS seg FROM customer WHERE c_mktsegment='MACHINERY'"),
    "construct_edges": (construct_edges, f"""SELECT '<urn:data:region/' || n_regionkey || '>' AS s, '<{_T}contains>' AS p, '<urn:data:nation/' || n_nationkey || '>' AS o FROM nation UNION SELECT '<urn:data:nation/' || n_nationkey || '>', '<{_T}label>', '"' || n_name || '"' FROM nation"""),
    "construct_where": (construct_where, _NATION_CONSTRUCT),
    "custom_function": (custom_function, "SELECT n_name AS n, reverse(n_name) AS back FROM nation"),
    "graph_named": (graph_named, f"SELECT '{_T}Region' AS g, 3*count(*) AS n FROM region UNION ALL SELECT '{_T}Nation', 4*count(*) FROM nation"),
    "graph_fixed": (graph_fixed, "SELECT r_name AS name FROM region"),
    "graph_from": (graph_from, "SELECT 4*count(*) AS n FROM nation"),
    "triples_join": (triples_join, "SELECT n_name AS n, n_nationkey::VARCHAR AS k FROM nation JOIN region ON n_regionkey=r_regionkey WHERE r_name='EUROPE' AND n_nationkey>3"),
    "variable_predicate": (variable_predicate, f"SELECT p, count(*) AS n FROM (SELECT unnest(['{RDF_TYPE}','{_T}r_regionkey','{_T}r_name']) AS p FROM region UNION ALL SELECT unnest(['{RDF_TYPE}','{_T}n_nationkey','{_T}n_name','{_T}inRegion']) FROM nation) GROUP BY p"),
    "vocab_types": (vocab_types, "SELECT unnest(string_split('Region Nation Customer Supplier Part Order LineItem Event Document Label Page Turn Item Vector Party User', ' ')) AS type"),
    "vocab_domains": (vocab_domains, f"SELECT DISTINCT e[2] AS property, e[1] AS class FROM ({_SPLIT_EDGES}) UNION ALL SELECT e[2], e[1] FROM ({_SPLIT_COLUMNS})"),
    "vocab_ranges": (vocab_ranges, f"SELECT DISTINCT e[2] AS property, e[3] AS class FROM ({_SPLIT_EDGES})"),
    "vocab_closure": (vocab_closure, "SELECT * FROM (VALUES ('Customer','Party'),('Supplier','Party')) v(class, super)"),
    "vocab_inverses": (
        vocab_inverses,
        "WITH x(p, q) AS (VALUES ('inRegion', 'hasNation'), ('placedBy', 'placed'), ('ofOrder', 'hasItem'), ('ofPart', 'partOf'), ('suppliedBy', 'supplies'), ('byUser', 'triggered'), ('follows', 'followedBy'), ('inNation', 'hasParty'))"
        " SELECT p AS property, q AS inverse FROM x UNION ALL SELECT q, p FROM x",
    ),
    "vocab_paths": (vocab_paths, "SELECT path, 1::INTEGER AS seeds FROM (VALUES ('Region.hasNation Nation.hasParty Customer.placed'), ('Region.hasNation Nation.hasParty Supplier.supplies LineItem.ofOrder')) v(path)"),
    "vocab_cycles": (vocab_cycles, _CYCLES),
    "seed_digest": (seed_digest, "SELECT 'Region' AS type, to_base64(from_hex(md5(string_agg('urn:data:region/' || r_regionkey, '' ORDER BY 'urn:data:region/' || r_regionkey)))) AS digest FROM region"),
    "reach_seed_region": (reach_seed_region, "SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey=2 AND c_mktsegment='BUILDING'"),
    "reach_seed_orders": (reach_seed_orders, "SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey=2"),
    "reach_fixpoint_turns": (reach_fixpoint_turns, "WITH RECURSIVE r(conv_id,turn) AS (SELECT conv_id, max(turn) FROM conversations GROUP BY 1 UNION SELECT c.conv_id, c.turn FROM r JOIN conversations c ON c.conv_id=r.conv_id AND c.turn=r.turn-1) SELECT conv_id AS conv, turn FROM r"),
    "reach_event_chain": (
        reach_event_chain,
        "WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) + (SELECT min(event_id) FROM events) - 1 AS n FROM (SELECT DISTINCT event_id FROM events)) SELECT event_id FROM e WHERE event_id=n UNION ALL SELECT max(event_id) + 1 FROM e WHERE event_id=n",
    ),
    "reach_customers": (reach_customers, "SELECT 'customer/' || c_custkey AS c FROM customer JOIN nation ON n_nationkey=c_nationkey WHERE n_regionkey=2"),
    "fragment_answers": (
        fragment_answers,
        "SELECT c_name AS x, c_acctbal AS bal, unnest(['own', 'collected']) AS w FROM customer JOIN nation ON n_nationkey=c_nationkey WHERE n_regionkey=2",
    ),
    "fragment_quads": (fragment_quads, _QUADS),
    "fragment_filtered": (fragment_filtered, "WITH x AS (SELECT * FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_totalprice>300000 AND c_acctbal<0), y AS (SELECT DISTINCT o_custkey FROM orders), z AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal<0 AND c_custkey IN (SELECT o_custkey FROM orders)) SELECT 'tp_0' AS tp, 'orders/' || o_orderkey AS s, 'customer/' || o_custkey AS o FROM x UNION SELECT 'tp_1', 'orders/' || o_orderkey, o_totalprice::VARCHAR FROM x UNION SELECT 'tp_2', 'customer/' || c_custkey, c_acctbal::VARCHAR FROM z"),
    "fragment_from_seed": (fragment_from_seed, _NATION),
    "fragment_cached_generalised": (fragment_cached_generalised, _QUADS),
    "ttl_fresh": (ttl_fresh, "SELECT event_type, count(*) AS n, min(e) AS ttl FROM (SELECT event_type, floor(epoch(ts))::BIGINT + (event_id % 1000) * 60 AS e FROM events) WHERE e > floor(epoch(TIMESTAMP '2024-01-15 00:00:00'))::BIGINT GROUP BY 1"),
    "incremental_bgp": (incremental_bgp, "SELECT c_name AS n, o_orderpriority AS p, 'urn:data:orders/' || o_orderkey AS x FROM orders JOIN customer ON o_custkey=c_custkey"),
    "live_tail": (
        live_tail,
        "WITH RECURSIVE e AS (SELECT user_id, event_type, floor(epoch(ts))::BIGINT AS s FROM events), told(user_id, event_type, s) AS (SELECT user_id, event_type, min(s) FROM e GROUP BY 1, 2 UNION ALL"
        f" SELECT t.user_id, t.event_type, min(e.s) FROM told t JOIN e ON e.user_id=t.user_id AND e.event_type=t.event_type AND e.s>t.s+{TTL} GROUP BY t.user_id, t.event_type, t.s)"
        f" SELECT user_id, event_type, s AS ts FROM told WHERE s>{REPLAYED} UNION ALL SELECT user_id, event_type, min(s) FROM e WHERE s<={REPLAYED} GROUP BY 1, 2",
    ),
    "sparql_json": (sparql_json, """SELECT '{"r":{"type":"uri","value":"urn:data:region/' || r_regionkey || '"},"k":{"type":"typed-literal","value":"' || r_regionkey || '","datatype":"http://www.w3.org/2001/XMLSchema#integer"},"n":{"type":"literal","value":"' || r_name || '"}}' AS binding FROM region"""),
    "quad_text": (quad_text, f"SELECT 'tp_0' AS tp, 'urn:data:nation/' || n_nationkey AS s, '{_T}inRegion' AS p, 'urn:data:region/' || n_regionkey AS o FROM nation UNION SELECT 'tp_1', 'urn:data:region/' || r_regionkey, '{_T}r_name', r_name FROM region"),
    "turtle_round_trip": (
        turtle_round_trip,
        f"SELECT '{RDF_TYPE}' AS p, NULL::VARCHAR AS dt, count(*) AS n, 1::BIGINT AS d FROM supplier UNION ALL SELECT '{_T}inNation', NULL, count(*), count(DISTINCT s_nationkey) FROM supplier"
        f" UNION ALL SELECT '{_T}s_suppkey', '{XSD}integer', count(*), count(DISTINCT s_suppkey) FROM supplier UNION ALL SELECT '{_T}s_nationkey', '{XSD}integer', count(*), count(DISTINCT s_nationkey) FROM supplier"
        f" UNION ALL SELECT '{_T}s_name', '{XSD}string', count(*), count(DISTINCT s_name) FROM supplier UNION ALL SELECT '{_T}s_acctbal', '{XSD}double', count(*), count(DISTINCT s_acctbal) FROM supplier",
    ),
    "plan_length": (plan_length, "SELECT 'Region' AS from_type, 'hasNation' AS steps, 7::INTEGER AS length"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _run(q) for k, (q, _) in SPARQL.items()} | {k: f for k, (f, _) in (MORE | LINKED | MARKET).items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in SPARQL.items()} | {k: sql for k, (_, sql) in (MORE | LINKED | MARKET).items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(SPARQL["bgp_path"][0])(spark, sf_dir)

