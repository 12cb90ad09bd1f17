"""SQL that puts numbers in French words, for the queries' counterparts: a table of 0 to 999, then groups of three digits."""

#: CTEs; `spoken` has one row with the words of 0 .. 999 as they end a number (lw) and as they stand before "mille" (li).
WORDS = """
base AS (SELECT ['zéro','un','deux','trois','quatre','cinq','six','sept','huit','neuf','dix','onze','douze','treize','quatorze','quinze','seize','dix-sept','dix-huit','dix-neuf'] AS u, ['vingt','trente','quarante','cinquante','soixante'] AS t),
tens AS (SELECT n, CASE WHEN n < 20 THEN u[n + 1]
  WHEN n < 70 THEN t[n // 10 - 1] || CASE n % 10 WHEN 0 THEN '' WHEN 1 THEN ' et un' ELSE '-' || u[n % 10 + 1] END
  WHEN n = 71 THEN 'soixante et onze' WHEN n < 80 THEN 'soixante-' || u[n - 59]
  WHEN n = 80 THEN 'quatre-vingts' ELSE 'quatre-vingt-' || u[n - 79] END AS w FROM base, (SELECT unnest(range(100)) AS n)),
hundreds AS (SELECT h * 100 + n AS n, CASE WHEN h = 0 THEN w WHEN n = 0 THEN CASE WHEN h = 1 THEN 'cent' ELSE u[h + 1] || ' cents' END ELSE CASE WHEN h = 1 THEN 'cent ' ELSE u[h + 1] || ' cent ' END || w END AS w
  FROM tens, base, (SELECT unnest(range(10)) AS h)),
spoken AS (SELECT list(w ORDER BY n) AS lw, list(regexp_replace(regexp_replace(w, 'quatre-vingts$', 'quatre-vingt'), ' cents$', ' cent') ORDER BY n) AS li,
  ['million','milliard','billion','billiard','trillion','trilliard','quadrillion','quadrilliard','quintillion','quintilliard','sextillion','sextilliard','septillion','septilliard','octillion','octilliard','nonillion','nonilliard','décillion','décilliard'] AS names FROM hundreds)
"""

_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_GROUP = f"CAST(substring(lpad({_DIGITS}, 66, '0'), 64 - 3 * g, 3) AS INT)"
NUMBER = (
    f"CASE WHEN length({_DIGITS}) > 66 THEN array_to_string(list_transform(regexp_extract_all({_DIGITS}, '.'), lambda c: lw[CAST(c AS INT) + 1]), ' ') "
    f"WHEN ltrim({_DIGITS}, '0') = '' THEN lw[1] ELSE array_to_string(list_filter(list_transform(range(21, -1, -1), lambda g: CASE WHEN {_GROUP} = 0 THEN '' WHEN g = 0 THEN lw[{_GROUP} + 1] "
    f"WHEN g = 1 THEN CASE WHEN {_GROUP} = 1 THEN 'mille' ELSE li[{_GROUP} + 1] || ' mille' END "
    f"ELSE lw[{_GROUP} + 1] || ' ' || names[g - 1] || CASE WHEN {_GROUP} > 1 THEN 's' ELSE '' END END), lambda w: w <> ''), ' ') END"
)
#: All numbers of a text; the row must have lw, li and names.
ALL = (
    r"array_to_string(list_transform(string_split(regexp_replace({0}, '(\d+(?:[\s.,]\d+)*)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda y, i: CASE WHEN i % 2 = 0 THEN "
    + NUMBER.format("y")
    + " ELSE y END), '')"
)
