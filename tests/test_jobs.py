import random

import pytest
from pyspark.sql import functions as F, types as T

from helpers import FOUR, rows
from strataframe.plans import appearances as app, occurrences as occ, reports, stages, traits
from strataframe.sources import landing, tables
from strataframe.sources.dimensions import Intervals, interval_keys, take_dimension
from strataframe.sources.manifest import GENUS_REQUEST, request_manifest
from strataframe.schemas import OCCURRENCES, RAW_TRAITS

TRAIT_COLUMNS = ("Taxa", "Taxonomic_rank", "Group", "Clade", "Max_size_m", "Guild", "Vertical", "Habitat",
                 "Early_era", "Late_era", "Early_period", "Late_period", "Early_epoch", "Late_epoch")


def trait(taxa, size=("2.5",), rank="species", group="Birds", clade="c", early="Old", late="New", **other):
    row = dict.fromkeys(TRAIT_COLUMNS) | dict(Taxa=taxa, Taxonomic_rank=rank, Group=group, Clade=clade,
                                              Max_size_m=list(size), Early_epoch=early, Late_epoch=late)
    return tuple((row | other)[c] for c in TRAIT_COLUMNS)


def trait_table(spark, *rows_):
    return traits.prepare_traits(spark.createDataFrame(list(rows_), RAW_TRAITS), FOUR, {"late_epoch": {"Newer": "New"}})


def test_curation(spark):
    raw = spark.createDataFrame([
        trait("A b", ("2.5",), group="Bony_fishes"), trait("Solo", ("abc",)), trait("Gone x", ()),
        trait("Small y", ("0.9",)), trait("Two z extra", ("3", "6")),
    ], RAW_TRAITS)
    got = traits.curate_traits(raw)
    assert rows(got, "taxa", "species", "group", "group_clps", "size_cat") == [
        ("A b", "b", "Bony fishes", "Fishes", "<5m"),
        ("Two z extra", "z", "Birds", "Birds", "5-10m"),
        ("Two z extra", "z", "Birds", "Birds", "<5m"),
    ]


def test_trait_sheets_are_stacked(spark, tmp_path):
    header = ",".join(TRAIT_COLUMNS)
    for i, size in enumerate(("2.5", "", "abc")):
        cells = ["A b", "species", "Birds", "c", size] + [""] * 7 + ["Old", "New"]
        (tmp_path / f"sheet{i}.csv").write_text(header + "\n" + ",".join(cells) + "\n")
    sheets = landing.read_trait_parts(spark, [str(tmp_path / f"sheet{i}.csv") for i in range(3)])
    assert sheets.count() == 3 and sheets.select("source_key").distinct().count() == 3
    assert rows(traits.curate_traits(sheets), "taxa", "max_size_m", "guild") == [("A b", 2.5, None)]


def test_epoch_correction_and_ages(spark):
    raw = spark.createDataFrame([trait("A a", late="Newer"), trait("B b", late=None), trait("C c", late="Odd")], RAW_TRAITS)
    curated = traits.curate_traits(raw)
    assert rows(traits.unmatched_epochs(curated, "late_epoch", FOUR)) == [("Newer",), ("Odd",)]
    aged = traits.attach_ages(traits.correct_epochs(curated, {"late_epoch": {"Newer": "New"}}), FOUR)
    assert rows(aged, "taxa", "late_epoch", "age_late_epoch", "age_early_epoch") == [
        ("A a", "New", 0.0, 40.0), ("B b", None, None, 40.0), ("C c", "Odd", None, 40.0)]


def test_range_through(spark):
    t = trait_table(spark, trait("Aa one"), trait("Aa two", group="Mammals"), trait("Bb one", rank="genus"))
    o = spark.createDataFrame([
        ("Aa one", 35.0, 25.0), ("Aa one", 22.0, 19.0), ("Aa other", 19.0, 15.0), ("Bb one", 19.0, 15.0),
        ("Aa one", 5.0, 4.0),  # no older bin: dropped
    ], "accepted_name string, max_ma double, min_ma double")
    got = stages.range_through(o, t, FOUR)
    # The genus is listed under two groups: every row twice.
    one = rows(got.where("accepted_name = 'Aa one' and group = 'Birds'"), "bin_occ", "ext_signal", "group_id")
    assert one == [(1, 0, "megafauna"), (2, 0, "megafauna"), (3, 1, "megafauna")]
    assert got.where("accepted_name = 'Aa one'").count() == 6
    assert rows(got.where("accepted_name = 'Aa other'"), "group", "group_id") == [("Birds", "baseline"), ("Mammals", "baseline")]
    assert got.where("genus = 'Bb'").count() == 0
    per_taxon = got.where("group = 'Birds'").groupBy("accepted_name").agg(F.sum("ext_signal").alias("n"))
    assert {r.n for r in per_taxon.collect()} == {1}


def test_single_stage_sightings(spark):
    t = trait_table(spark, trait("Aa one"))
    o = spark.createDataFrame([("Aa one", 30.0, 20.0), ("Aa one", 29.0, 21.0), ("Aa one", 28.0, 21.0), ("Aa one", 39.0, 12.0)],
                              "accepted_name string, max_ma double, min_ma double")
    assert rows(stages.single_stage_occurrences(o, t, FOUR)) == [("Aa one", 2, "megafauna", "Birds")]
    exact = o.where("max_ma = 30")
    assert stages.single_stage_occurrences(exact, t, FOUR).count() == 0
    assert stages.single_stage_occurrences(exact, t, FOUR, closed="left").count() == 1


def test_richness_counts_every_stage_between(spark):
    t = trait_table(spark, trait("A a", early="Old", late="Mid"), trait("B b", early="Mid", late="Mid"))
    assert rows(stages.standing_richness(t, FOUR)) == [("Birds", 1, 1, 35.0), ("Birds", 2, 1, 25.0), ("Birds", 3, 2, 15.0)]


def test_overview_fills_one_side_only(spark):
    per_taxon = spark.createDataFrame(
        [("all", 3), ("all", 2), ("none", 0), ("single", 1), ("mixed", 0), ("mixed", 1), ("mixed", 5)], "group string, occurrences long")
    assert rows(occ.overview(per_taxon)) == [
        ("all", 1.0, 2, 0, 0.0), ("mixed", 2 / 3, 2, 1, 0.5), ("none", None, None, None, None), ("single", 1.0, 1, 1, None)]
    assert rows(occ.presence_percent(per_taxon), "group", "pres_perc") == [
        ("all", 100.0), ("mixed", pytest.approx(200 / 3)), ("none", None), ("single", 100.0)]


def test_synonyms_and_counts(spark):
    raw = spark.createDataFrame([
        ("1", "Newa b", "Olda n. b", "subjective synonym of", "species"),
        ("2", "Newa b", "Newa b", None, "species"),
        ("2", "Newa b", "Newa b", None, "species"),
        ("3", "Newa", "Newa c", "recombined as", "genus"),
        ("4", "Other x", "Other x", None, "family"),
    ], "occurrence_no string, accepted_name string, identified_name string, difference string, accepted_rank string")
    cleaned = occ.clean_occurrences(raw)
    assert cleaned.count() == 3 and occ.clean_occurrences(raw, dedupe=False).count() == 4
    syn = occ.synonym_table(cleaned, ["subjective synonym of", "recombined as"])
    assert rows(syn) == [("Newa b", "Olda b")]
    t = trait_table(spark, trait("Olda b"), trait("Lonely sp.", rank="genus"))
    resolved = occ.resolve_names(occ.taxon_names(t), syn)
    assert rows(resolved) == [("Lonely", None, None, "Lonely"), ("Olda b", "Olda b", "Newa b", "Newa b")]
    counted = occ.occurrences_per_taxon(resolved, cleaned, t)
    assert rows(counted, "taxon", "occurrences", "synonym", "taxa", "group") == [
        ("Lonely", 0, None, "Lonely", "Birds"), ("Newa b", 2, "Olda b", "Olda b", "Birds")]
    cov = {r.level: (r.matched, r.total) for r in occ.coverage(occ.taxon_names(t), occ.known_names(cleaned, syn)).collect()}
    assert cov == {"genus": (1, 2), "genus_only": (0, 1), "species": (1, 1)}


def test_appearances(spark):
    keys = interval_keys(spark, {"I1": 1, "I2": 2, "I3": 3, "I4": 4})
    o = spark.createDataFrame([("A a", "I1", "I2"), ("A a", "I3", None), ("B b", "I2", "unknown"), ("Z z", "I1", None)],
                              "accepted_name string, early_interval string, late_interval string")
    resolved = spark.createDataFrame([("A a", "A a"), ("B b", "B b")], "taxon string, taxon_clean string")
    got = app.appearances_from_occurrences(o, resolved, keys, FOUR)
    assert rows(got) == [("A a", 35.0, 15.0, 1, 3)]
    published = app.appearances_from_occurrences(o, resolved, keys, FOUR, as_published=True)
    assert rows(published, "taxon", "fad_pbdb", "lad_pbdb") == [("A a", 25.0, 15.0)]


def test_appearances_collapse_per_spelling(spark):
    keys = interval_keys(spark, {"I1": 1, "I2": 2, "I3": 3})
    o = spark.createDataFrame([("A a", "I2", None), ("A ? a", "I1", "I3"), ("B b", "I1", None), ("B ? b", "unknown", "I2")],
                              "accepted_name string, early_interval string, late_interval string")
    resolved = spark.createDataFrame([("A a", "A a"), ("B b", "B b")], "taxon string, taxon_clean string")
    got = app.appearances_from_occurrences(o, resolved, keys, FOUR)
    assert rows(got, "taxon", "fad_stg", "lad_stg") == [("A a", 1, 3)]
    # Names are cleaned once a spelling, not once for each of its intervals.
    groupings = [line.split("]")[0] for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in line]
    assert groupings and not any("_interval" in g for g in groupings)


def test_appearance_counts_drop_unmatched(spark):
    t = trait_table(spark, trait("A a", Early_period="Lower", Late_period="Upper"),
                    trait("B b", Early_period="Lower", Late_period="Lower"), trait("C c", Early_period="Upper", Late_period="Elsewhere"))
    got = app.appearances_per_period(t, FOUR)
    third = 100 / 3
    assert rows(got) == [("Birds", "Lower", 2, pytest.approx(2 * third), 1, 50.0), ("Birds", "Upper", 1, pytest.approx(third), 1, 50.0)]
    solo = trait_table(spark, trait("A a", Early_period="Lower", Late_period="Upper"))
    assert app.appearances_per_period(solo, FOUR).count() == 0
    printed = app.publication_table(got, FOUR)
    assert printed.columns == ["Taxon", "Period", "#FADs", "#LADs"] and rows(printed)[0][:2] == ("", "Upper")


def test_epoch_order_is_numeric(spark):
    many = Intervals.from_rows([(i, f"E{i}", "S", 100.0 - i, 99.0 - i, 99.5 - i, 1.0) for i in range(1, 13)])
    c = spark.createDataFrame([("t", "E9", "E10"), ("u", "E10", "E9"), ("v", "E9", "E9")],
                              "taxon string, early_epoch_pbdb string, early_epoch string")
    assert rows(app.older_epochs(c, many), "taxon", "pbdb_bin", "bin") == [("t", 9, 10)]


def test_missing_at_random_refuses_constant_response(spark):
    t = trait_table(spark, trait("A a", Guild="Herbivore", Vertical="Pelagic", Habitat="Oceanic"),
                    trait("B b", Guild="Herbivore", Vertical="Benthic", Habitat="Oceanic"), trait("C c"))
    with pytest.raises(ValueError, match="constant"):
        reports.missing_at_random(t, ["guild", "vertical", "habitat"])


def test_longest_lived(spark):
    t = trait_table(spark, trait("A a", early="Old", late="New"), trait("B b", early="Old", late="New", group="Mammals"),
                    trait("C c", early="New", late="New"), trait("D d", late=None))
    assert rows(reports.longest_lived(t, FOUR, 1), "taxa", "age_range") == [("A a", 25.0)]
    assert rows(reports.groups_of_longest_lived(t, FOUR, 3)) == [("Birds", 2), ("Mammals", 1)]


def test_spatial(spark):
    t = trait_table(spark, trait("Aa one"))
    o = spark.createDataFrame([("Aa", 300.0, 260.0, 1.0, 2.0), ("Aa", 300.0, 100.0, 1.0, 2.0), ("Zz", 50.0, 40.0, 0.0, 0.0)],
                              "genus string, max_ma double, min_ma double, lng double, lat double")
    assert rows(reports.spatial_by_era(o, t)) == [(1.0, 2.0, "Paleozoic", "Birds")]


def test_spatial_density_does_not_repeat_the_groups(spark):
    t = spark.createDataFrame([("species", "Birds", "Aa"), ("genus", "Fishes", "Aa")], "taxonomic_rank string, group string, genus string")
    o = spark.range(40).selectExpr("if(id % 4 = 0, 'Zz', 'Aa') as genus", "300D as max_ma", "260D as min_ma", "1D as lng", "cast(id as double) as lat")
    located = reports.spatial_by_era(o, t)
    # Copies of the groups, one per salt, would be broadcast to every task.
    assert "Generate" not in located._jdf.queryExecution().optimizedPlan().toString()
    assert located.count() == 2 * 30
    got = reports.coordinate_density(located, "lat", grid=64, out_points=8).collect()
    assert [r.era for r in got] == ["Paleozoic"] * 8 and max(r.x for r in got) == 39.0


def test_landing_directory(spark, tmp_path):
    columns = OCCURRENCES.names
    def line(**kw):
        return "\t".join(str(kw.get(c, "")) for c in columns)
    (tmp_path / "full.tsv").write_text("\n".join(["\t".join(columns), line(occurrence_no=1, accepted_name='A "b', max_ma=3.5),
                                                  line(occurrence_no=2, accepted_name="A b", max_ma="bad")]) + "\n")
    (tmp_path / "empty.tsv").write_text("occurrence_no\nTHIS REQUEST RETURNED NO RECORDS\n")
    (tmp_path / "narrow.tsv").write_text("occurrence_no\treid_no\n5\t6\n")
    got = landing.read_occurrences(spark, str(tmp_path), quoting=False)
    assert rows(got, "occurrence_no", "accepted_name", "max_ma") == [("1", 'A "b', 3.5), ("2", "A b", None)]
    assert {r[0].rsplit("/", 1)[1] for r in got.select("source_key").collect()} == {"full.tsv"}


def test_responses_by_header(spark, tmp_path):
    schema = "id string, name string, age double, note string"
    put = lambda name, *lines: (tmp_path / name).write_text("".join("\t".join(line) + "\n" for line in lines))
    put("a.tsv", ("id", "name", "age", "note"), ("1", 'x "y', "2.5", ""), ("2", "", "", ""))
    put("b.tsv", ("note", "other", "age", "id"), ("n", "o", "no number", "3"))
    put("c.tsv", ("id", "name"), ("4", "gone"))
    put("d.tsv", ("id", "name", "age"), ("5", "gone", "1"), (landing.NO_RECORDS,))
    put("e.tsv", (landing.NO_RECORDS,))
    put("f.tsv", ("id", "name", "age"))
    got = landing.read_by_header(spark, str(tmp_path), spark.createDataFrame([], schema).schema, quoting=False)
    # A row with two cells of a full file stays, the rows of a two-column file go.
    assert rows(got, "id", "name", "age", "note") == [("1", 'x "y', 2.5, None), ("2", None, None, None), ("3", None, None, "n")]
    put("g.tsv", ("what", "is", "this"), ("1", "2", "3"))
    with pytest.raises(Exception, match="no header in"):
        landing.read_by_header(spark, str(tmp_path), got.drop("source_key").schema, quoting=False).collect()


@pytest.mark.parametrize("quoting", [True, False])
def test_headers_in_odd_places(spark, tmp_path, quoting):
    schema = spark.createDataFrame([], "id string, name string, age double").schema
    mark = '"' if quoting else ""
    put = lambda name, *lines: (tmp_path / name).write_text("".join(line + "\n" for line in lines))
    put("a.tsv", "0\tbefore the header\t1", f"{mark}name{mark}\tage\tid", "identity\t2\t7", "", "x\t\t8\tmore\tcells" + "\tz" * 20)
    put("b.tsv", "id\tname\tage", "1\tgone\t1", f"{mark}{landing.NO_RECORDS}{mark}")
    put("c.tsv", "id\tname\tage", f"{landing.NO_RECORDS} of this kind\tstays")
    got = landing.read_by_header(spark, str(tmp_path), schema, quoting=quoting)
    assert rows(got, "id", "name", "age") == [
        ("1", "0", None), ("7", "identity", 2.0), ("8", "x", None), (f"{landing.NO_RECORDS} of this kind", "stays", None)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # Nothing is interpreted row by row, and one declared column is not read: a row of another length is no malformed one.
    assert "exists(" not in plan
    relation = next(line for line in plan.splitlines() if "Relation [" in line and "csv" in line)
    assert "_c12#" in relation and plan.count("_c12#") == 1


def test_trait_lists(spark, tmp_path):
    schema = T.StructType([T.StructField("Taxa", T.StringType()), T.StructField("Sizes", T.ArrayType(T.StringType()))])
    (tmp_path / "one.csv").write_text("Taxa,Sizes\nA,2;unknown;3.5\nB,\nC,7\n")
    got = landing.read_trait_parts(spark, str(tmp_path), schema, source_key=None)
    assert {r.Taxa: r.Sizes for r in got.collect()} == {"A": ["2", "unknown", "3.5"], "B": [], "C": ["7"]}


def test_empty_sources_and_repeats(spark):
    df = spark.createDataFrame([("THIS REQUEST RETURNED NO RECORDS", None, None, "s1"), ("9", "a", "b", "s1"),
                                ("1", None, "x", "s2"), ("1", None, "x", "s3"), (None, "q", "x", "s3")],
                               "occurrence_no string, b string, c string, source_key string")
    kept = landing.drop_empty_sources(df, payload=["occurrence_no", "b", "c"])
    assert rows(kept, "occurrence_no", "source_key") == [(None, "s3"), ("1", "s2"), ("1", "s3")]
    assert landing.drop_repeated_occurrences(kept).count() == 2


def test_manifest(spark):
    names = spark.createDataFrame([("A b c",), ("A b c",), ("Solo",), (None,)], "taxa string")
    got = {r.taxon: r.request_key for r in request_manifest(names, "taxa").collect()}
    assert got == {"A b c": "base_name=A%20bc&extant=no&show=classext,ident,coords",
                   "Solo": "base_name=Solo&extant=no&show=classext,ident,coords"}
    genus = request_manifest(names, "taxa", params=GENUS_REQUEST, escape_blank=False, endpoint="x?")
    assert genus.where("taxon = 'Solo'").first().request_key == (
        "x?base_name=Solo&idreso=species&extant=no&show=classext,ident&idqual=certain")


def test_csv_writes_na(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([("Mammals", None)], "group string, p_star string").coalesce(1), str(tmp_path / "o"))
    (part,) = (tmp_path / "o").glob("part-*.csv")
    assert part.read_text() == "group,p_star\nMammals,NA\n"


def test_dimensions_are_size_checked(spark):
    with pytest.raises(ValueError):
        take_dimension(spark.range(20), max_rows=10)
    assert Intervals.from_dataframe(FOUR.to_df(spark)) == FOUR
    assert FOUR.systems == ["Lower", "Upper"] and FOUR.series == ["Old", "Mid", "New"]
    bins = spark.createDataFrame([(2,), (3,)], "bin int")
    assert rows(FOUR.durations(spark, bins)) == [(2, 10.0), (3, 10.0)]


def many_stages(n, first=1, step=1):
    return Intervals.from_rows([(first + i * step, f"S{i // 5}", f"Y{i // 20}", float(2 * (n - i)), float(2 * (n - i) - 2), 2.0 * (n - i) - 1, 2.0) for i in range(n)])


@pytest.mark.parametrize("n, first, step", [(95, 1, 1), (95, 40, 1), (130, -7, 3), (600, 5, 2)])
def test_stages_of_any_number_and_numbering(spark, n, first, step):
    table = many_stages(n, first, step)
    rng = random.Random(n)
    ages = [(rng.choice([rng.uniform(-3, 2 * n + 3), 2.0 * rng.randrange(n + 1)]), i) for i in range(400)]
    ages = [(max(a, b), min(a, b)) for (a, _), (b, _) in zip(ages, ages[1:] + ages[:1])] + [(7.0, 6.5), (2.0 * n, 2.0 * n - 1), (None, 3.0)]
    occurrences = spark.createDataFrame([(f"Gen sp{i % 50}", a, b) for i, (a, b) in enumerate(ages)], "accepted_name string, max_ma double, min_ma double")

    # Bin i of the ascending bounds is right-closed; the lowest bound is in the first.
    def cut(age, bounds):
        if age is None or not bounds[0] <= age <= bounds[-1]:
            return None
        return max(1, next(i for i, b in enumerate(bounds) if age <= b))

    older = {a: None if (c := cut(a, table.bottoms[::-1])) is None else table.numbers[n - c - 1] for a, _ in ages}
    younger = {b: None if (c := cut(b, table.tops[::-1])) is None else table.numbers[n - c] for _, b in ages}
    got = rows(stages.bin_bounds(occurrences, table).select("max_ma", "min_ma", "bin_max", "bin_min"))
    assert got == sorted((a, b, older[a], younger[b]) for a, b in ages if older[a] is not None and younger[b] is not None)

    traits = spark.createDataFrame([("Gen sp1", "species", "Gen", "G")], "taxa string, taxonomic_rank string, genus string, group string")
    seen = stages.single_stage_occurrences(occurrences, traits, table)
    want = {(f"Gen sp{i % 50}", older[a]) for i, (a, b) in enumerate(ages) if older[a] is not None and older[a] == younger[b]}
    assert {(r.accepted_name, r.bin) for r in seen.collect()} == want
    bins = [b for _, b in want]
    matrix = stages.presence_absence(seen, table)
    assert matrix.columns[2:] == [f"bin_{b}" for b in table.numbers if min(bins) <= b <= max(bins)]
    assert [r.stg for r in table.durations(spark, seen).collect()] == [int(c[4:]) for c in matrix.columns[2:]]


def test_interval_tables_are_checked():
    with pytest.raises(ValueError):
        Intervals.from_rows([(1, "a", "b", 3.0, 2.0, 2.5, 1.0), (1, "a", "b", 2.0, 1.0, 1.5, 1.0)])
    with pytest.raises(ValueError):
        Intervals.from_rows([(1, "a", "b", 2.0, 1.0, 1.5, 1.0), (2, "a", "b", 3.0, 2.0, 2.5, 1.0)])


def test_names_are_cleaned_above_their_aggregate(spark):
    raw = spark.createDataFrame([("G. sp. one", "G ? one", "subjective synonym of")] * 3, "accepted_name string, identified_name string, difference string")
    for df in (occ.synonym_table(raw, ["subjective synonym of"]), occ.name_counts(raw).where("name is not null")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.rindex("Aggregate ["):].split("\n", 1)[1]
        assert "regexp_replace" in plan and "regexp_replace" not in below
