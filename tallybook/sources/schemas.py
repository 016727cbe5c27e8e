"""Schemas of what is read; nothing is inferred."""

EVENT = "ts long, key binary, value long, source_id int"
BATCH = (
    "ingest_time_ms long, source_id int, source_batch_seq long, "
    "events array<struct<key_id: array<smallint>, value: long, ts: long>>, batch_hash array<smallint>"
)
MACHINE_TSV = "start_time long, value long"
MACHINE_CSV = "value string, machine_id string, end_time string"
VEHICLE = (
    "model_year string, make string, model string, vehicle_class string, engine_l string, cylinders string, transmission string, fuel string, "
    "city string, highway string, combined string, combined_mpg string, co2 string"
)
PACKET = "src_ip long, dst_ip long, length long, file string, problem string"
#: Tables of epochs, partitioned by epoch_type and aggregator_id where they have both.
EPOCH_TABLES = ["epoch_header", "samples_entries", "hist_cells", "hist_keys", "cm_cells", "cm_slots", "epoch_chain", "epoch_done", "raw_events", "source_tips"]
