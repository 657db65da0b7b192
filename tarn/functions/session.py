"""Context functions. Their values come from the session, which puts literals in
place of the calls; outside a session they have fixed defaults."""

from tarn.functions.registry import templates

DEFAULTS = {
    "current_client": "'tarn'", "current_database": "'main'", "current_ip_address": "''", "current_role": "'default'", "current_role_type": "'ROLE'",
    "current_schema": "'public'", "current_schemas": "to_json(array('main.public'))", "current_session": "''", "current_version": "version()",
    "current_warehouse": "'default'", "current_user": "current_user()", "version": "version()",
}
for _name, _text in DEFAULTS.items():
    templates(_name, _0=_text)
templates("last_query_id", _0="''", _1="''")
templates("sleep", _1="tarn_sleep({0})")
