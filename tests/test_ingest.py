"""CSV feeds: header sniffing, encodings, blanks, keyed insert-if-absent,
census time assembly and the drop-folder stream (FIXTURES.md §1-§2)."""

import datetime as dt
import os

from pyspark.sql import functions as F

from staylens.operators import ingest as I
from staylens.operators import keyed as K
from staylens.sources import csv_text as S
from staylens.streaming import streams as ST


def write(folder, name, text, encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    p = os.path.join(folder, name)
    with open(p, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return p


def test_minimal_upload_counts_one(spark, scratch):
    p = write(f"{scratch}/in", "a.csv", "\ufeffEpisodio,Marco Temporal,cama\nE1,04/03/2023 10:00,A1\n")
    raw = S.read_text_csv(spark, p)
    stays = I.normalize_stays(raw)
    rep = K.append_new(stays, f"{scratch}/stays", I.STAY_KEY, S.first_wins_order(),
                       drop_cols=S.first_wins_order())
    assert rep["total"] == 1 and rep["inserted"] == 1 and rep["duplicates"] == 0
    row = spark.read.parquet(f"{scratch}/stays").first()
    assert row["marca_temporal"] == dt.datetime(2023, 3, 4, 10, 0) and row["cama"] == "A1"
    assert row["_synthetic_identity"] is True and row["_tipo_fuente"] == "respuestas_formulario"


def test_semicolon_bom_latin1_blanks_and_duplicates(spark, scratch):
    text = ("Episodio;Marca Temporal;Nombre;Días Reales;Valor Parcial;Código\n"
            "E1;2023-03-04T10:00:00;José Núñez;12.5; $53.052.920 ;51401\n"
            "E1;2023-03-04T10:00:00;Otro;3;;51401\n"            # duplicate key in the file
            "E2;45000,5;\"\";  ;x;\n"
            ";04/03/2023 10:00;Sin Episodio;1;;\n")
    p = write(f"{scratch}/in", "b.csv", text, encoding="latin-1")
    raw = S.read_text_csv(spark, p)
    assert "dias_reales" in raw.columns and "codigo" in raw.columns
    stays = I.normalize_stays(raw)
    rep = K.append_new(stays, f"{scratch}/stays", I.STAY_KEY, S.first_wins_order(),
                       drop_cols=S.first_wins_order())
    assert rep == {"inserted": 3, "duplicates": 1, "total": 4, "unique_key_used": ["episodio", "marca_temporal"]}
    rows = {r["episodio"]: r for r in spark.read.parquet(f"{scratch}/stays").collect()}
    assert rows["E1"]["nombre"] == "José Núñez"                  # first in file order wins
    assert rows["E1"]["dias_reales"] == 125 and rows["E1"]["valor_parcial"] == " $53.052.920 "
    assert rows["E1"]["codigo"] == "51401"                      # a code is not a date by default
    assert rows["E2"]["marca_temporal"] == dt.datetime(2023, 3, 15, 12, 0)
    assert rows["E2"]["dias_reales"] is None
    assert rows[None]["marca_temporal"] == dt.datetime(2023, 3, 4, 10, 0)
    # key already loaded: a second upload inserts nothing
    rep2 = K.append_new(I.normalize_stays(S.read_text_csv(spark, p)), f"{scratch}/stays", I.STAY_KEY,
                        S.first_wins_order(), drop_cols=S.first_wins_order())
    assert rep2["inserted"] == 0 and rep2["duplicates"] == 4


def test_census_time_assembly(spark, scratch):
    p = write(f"{scratch}/c1", "camas 05-03-2025 1430.csv",
              "Unidad,Sala,Cama,Fecha,Hora,Episodio\nUCI,1, a 1 ,05/03/2025,1305,E1\n"
              "UCI,1,A2,05/03/2025,,E2\nUCI,1,A3,xx,13:05,E3\n")
    raw = S.read_text_csv(spark, p)
    rows, key = I.normalize_census(raw)
    assert key == ["unidad", "sala", "cama", "snapshot_at"]
    got = {r["cama"]: r for r in rows.collect()}
    assert got["A 1"]["snapshot_at"] == dt.datetime(2025, 3, 5, 13, 5)
    assert got["A2"]["snapshot_at"] == dt.datetime(2025, 3, 5, 0, 0)
    assert got["A3"]["snapshot_at"] == dt.datetime(2025, 3, 5, 14, 30)   # file-name fallback
    assert got["A 1"]["episodio"] == "E1"


def test_census_key_without_sala_and_missing_bed(spark, scratch):
    p = write(f"{scratch}/c2", "camas.csv", "Servicio,Bed\nMED,b2\n")
    rows, key = I.normalize_census(S.read_text_csv(spark, p))
    assert key == ["cama", "snapshot_at"] or key == ["unidad", "cama", "snapshot_at"]
    assert rows.first()["cama"] == "B2" and rows.first()["snapshot_at"] is None
    p2 = write(f"{scratch}/c3", "x.csv", "Unidad,Sala\nA,B\n")
    try:
        I.normalize_census(S.read_text_csv(spark, p2))
        raise AssertionError("a census without a bed column must fail")
    except ValueError:
        pass


def test_stream_drop_folder_is_idempotent(spark, scratch):
    src, table, ckpt = f"{scratch}/drop", f"{scratch}/stays", f"{scratch}/ckpt"
    write(src, "f1.csv", "episodio,marca_temporal,cama\nE1,2024-01-01 10:00:00,A\nE2,2024-01-01 11:00:00,B\n")
    reports = []
    stream = ST.text_stream(spark, src, ["episodio", "marca_temporal", "cama"])
    ST.run_available(stream, ST.stays_handler(table, reports), ckpt)
    write(src, "f2.csv", "episodio,marca_temporal,cama\nE2,2024-01-01 11:00:00,Z\nE3,2024-01-02 09:00:00,C\n")
    ST.run_available(ST.text_stream(spark, src, ["episodio", "marca_temporal", "cama"]),
                     ST.stays_handler(table, reports), ckpt)
    stored = spark.read.parquet(table)
    assert stored.count() == 3
    assert stored.where(F.col("episodio") == "E2").first()["cama"] == "B"   # stored row wins
    assert sum(r["inserted"] for r in reports) == 3


def test_census_stream(spark, scratch):
    src, table, ckpt = f"{scratch}/camas", f"{scratch}/camas_t", f"{scratch}/ckpt"
    cols = ["unidad", "sala", "cama", "estado"]
    write(src, "camas 05-03-2025 0800.csv", "unidad,sala,cama,estado\nUCI,1,a1,ocupada\nUCI,1,a2,libre\n")
    write(src, "camas 05-03-2025 2000.csv", "unidad,sala,cama,estado\nUCI,1,a1,libre\n")
    reports = []
    ST.run_available(ST.text_stream(spark, src, cols), ST.census_handler(table, reports), ckpt)
    t = spark.read.parquet(table)
    assert t.count() == 3 and reports[0]["unique_key_used"] == ["unidad", "sala", "cama", "snapshot_at"]
    snaps = sorted(r["snapshot_at"] for r in t.where(F.col("cama") == "A1").collect())
    assert snaps == [dt.datetime(2025, 3, 5, 8, 0), dt.datetime(2025, 3, 5, 20, 0)]


HUMAN_HEADERS = ["Marco Temporal", "Status", "Causa devolución/rechazo", "Última modificación", "Episodio",
                 "¿Qué gestión se solicitó?", "Fecha inicio", "Hora inicio", "Informe", "Tipo cuenta 1",
                 "Tipo cuenta 2", "Tipo cuenta 3", "Nombre", "Rut", "Fecha admisión", "Mes", "Año",
                 "Fecha alta", "Cama", "Texto libre diagnóstico admisión", "Diagnóstico transfer", "Convenio",
                 "Nombre de la aseguradora", "Valor parcial", "Solicitud de traslado", "Concretado",
                 "Días hospitalización", "Días reales", "Mes2", "Año2", "Fecha de nacimiento", "Sexo", "Estado",
                 "Motivo de cancelación", "Motivo de rechazo", "Tipo de solicitud", "Tipo de traslado",
                 "Motivo de traslado", "Centro de destinatario", "Nivel de atención", "Servicio/Especialidad",
                 "Fecha de finalización", "Hora de finalización", "Días solicitados homecare",
                 "Texto libre causa rechazo", "Observación"]


def test_full_header_row(spark, scratch):
    row = ["04/03/2023 10:00", "ok", "", "2023-03-05T08:00:00", "EP9", "traslado", "04/03/2023", "10:00", "",
           "A", "B", "C", "Ana Soto", "17085132-3", "01/03/2023", "3", "2023", "10/03/2023", "UCI-1",
           "dx", "", "FONASA", "", " $53.052.920 ", "si", "no", "9", "12.5", "", "", "15/06/1950", "Femenino",
           "activo", "", "", "", "", "", "", "", "", "10/03/2023 12:00", "12:00", "3", "", "  nota  "]
    assert len(row) == len(HUMAN_HEADERS)
    p = write(f"{scratch}/full", "f.csv", ",".join(f'"{h}"' for h in HUMAN_HEADERS) + "\n"
              + ",".join(f'"{v}"' for v in row) + "\n")
    stays = I.normalize_stays(S.read_text_csv(spark, p))
    for c in set(I.STAY_CANON.values()) | {"rut", "observacion", "_tipo_fuente", "_synthetic_identity"}:
        assert c in stays.columns, c
    r = stays.first()
    assert r["marca_temporal"] == dt.datetime(2023, 3, 4, 10, 0)
    assert r["ultima_modificacion"] == dt.datetime(2023, 3, 5, 8, 0)
    assert r["fecha_admision"] == dt.date(2023, 3, 1) and r["fecha_alta"] == dt.date(2023, 3, 10)
    assert r["fecha_de_nacimiento"] == dt.date(1950, 6, 15)
    assert r["fecha_de_finalizacion"] == dt.datetime(2023, 3, 10, 12, 0)
    assert r["run"] == r["rut"] == "17085132-3" and r["_synthetic_identity"] is False
    assert (r["dias_hospitalizacion"], r["dias_reales"], r["dias_solicitados_homecare"]) == (9, 125, 3)
    assert r["que_gestion_se_solicito"] == "traslado" and r["causa_devolucion_rechazo"] is None
    assert r["observacion"] == "  nota  "               # carried; blanks kept until read time
    assert r["riesgo_social"] is None and r["grd_code"] is None


def test_keyed_append_prunes_to_batch_partitions(spark, scratch):
    table = f"{scratch}/keyed"
    def batch(rows):
        df = spark.createDataFrame(rows, "episodio string, marca_temporal timestamp_ntz, v string, o int")
        return df.withColumn("dia", F.to_date("marca_temporal"))
    d1, d2 = dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 1, 2, 9)
    r1 = K.append_new(batch([("E1", d1, "a", 0), ("E2", None, "b", 1)]), table, ["episodio", "marca_temporal"],
                      ["o"], partition_by=["dia"])
    r2 = K.append_new(batch([("E1", d1, "x", 0), ("E1", d2, "c", 1), ("E2", None, "y", 2)]), table,
                      ["episodio", "marca_temporal"], ["o"], partition_by=["dia"])
    assert (r1["inserted"], r2["inserted"], r2["duplicates"]) == (2, 1, 2)
    stored = spark.read.parquet(table)
    assert stored.count() == 3 and {r["v"] for r in stored.collect()} == {"a", "b", "c"}
    assert any(n.startswith("dia=2024-01-02") for n in os.listdir(table))


def test_extra_column_date_heuristic_is_opt_in(spark, scratch):
    p = write(f"{scratch}/x", "x.csv", "episodio,marca_temporal,codigo,control\nE1,2024-01-01 10:00:00,51401,"
                                       "05/03/2024 08:30\n")
    raw = S.read_text_csv(spark, p)
    off = I.normalize_stays(raw).first()
    assert off["codigo"] == "51401" and off["control"] == "2024-03-05T08:30:00"
    on = I.normalize_stays(raw, extra_serials=True).first()
    assert on["codigo"] == "2040-09-22T00:00:00"          # the source's trap: a 5-digit code read as a serial
    assert on["control"] == "2024-03-05T08:30:00"


def test_files_keep_their_own_encoding_and_header_order(spark, scratch):
    folder = f"{scratch}/mixed"
    write(folder, "a.csv", "nombre,cama\nMuñoz,B1\n")
    with open(f"{folder}/b.csv", "wb") as f:
        f.write("cama;nombre\nB2;Peña\n".encode("iso-8859-1"))
    rows = {r["cama"]: r["nombre"] for r in S.read_text_csv(spark, folder).collect()}
    assert rows == {"B1": "Muñoz", "B2": "Peña"}


def test_rows_with_too_many_fields_come_back(spark, scratch):
    p = write(f"{scratch}/long", "x.csv", 'a,b\n1,2,3\n4\n"5,x",6\n')
    rows, bad = S.read_text_csv(spark, p, rejects=True)
    assert sorted((r["a"], r["b"]) for r in rows.collect()) == [("4", None), ("5,x", "6")]
    assert [r["_line"] for r in bad.collect()] == ["1,2,3"]


def test_a_large_file_is_split(spark, scratch):
    p = write(f"{scratch}/big", "x.csv", "a,b\n" + "some text,more text\n" * 60_000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        assert S.read_text_csv(spark, p).rdd.getNumPartitions() >= 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
