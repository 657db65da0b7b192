"""String, binary, hash and encryption functions."""

from tarn.functions.registry import constant, register, renamed, same, templates

same("ascii bit_length btrim char_length character_length chr concat concat_ws contains find_in_set initcap instr left levenshtein lpad ltrim octet_length overlay position repeat reverse right rpad rtrim split_part substring_index translate trim upper soundex space ucase lcase startswith endswith")
renamed(ends_with="endswith", starts_with="startswith", len="length", length="length", strpos="instr", substr_index="substring_index", substr="substring", substring="substring", uuid="uuid", uuid_string="uuid", editdistance="levenshtein", charindex="position")
templates("lower", _1="lower(cast({0} as string))")
templates("replace", _2="replace({0}, {1}, '')", _3="replace({0}, {1}, {2})")
templates("insert", _4="overlay({0} PLACING {3} FROM {1} FOR {2})")
templates("rtrimmed_length", _1="length(rtrim({0}))")
templates("md5 md5_hex", _1="md5(cast({0} as binary))")
templates("sha1 sha1_hex", _1="sha1(cast({0} as binary))")
templates("sha2 sha2_hex", _1="sha2(cast({0} as binary), 256)", _2="sha2(cast({0} as binary), {1})")
for bits in (224, 256, 384, 512):
    templates(f"sha{bits}", _1=f"sha2(cast({{0}} as binary), {bits})")
templates("hex_encode", _1="hex({0})", _2="if({1} = 0, lower(hex({0})), hex({0}))")
templates("hex_decode_binary", _1="unhex({0})")
templates("hex_decode_string", _1="decode(unhex({0}), 'UTF-8')")
templates("try_hex_decode_binary", _1="if({0} RLIKE '^([0-9A-Fa-f]{2})*$', unhex({0}), NULL)")
templates("try_hex_decode_string", _1="if({0} RLIKE '^([0-9A-Fa-f]{2})*$', decode(unhex({0}), 'UTF-8'), NULL)")
templates("base64_encode", _1="base64(cast({0} as binary))")
templates("base64_decode_string", _1="decode(unbase64({0}), 'UTF-8')")
# The delimiter is text, not a pattern.
_SPLIT = "split({0}, concat('\\\\Q', {1}, '\\\\E'), -1)"
templates("split", _2=f"to_json({_SPLIT})")
_PIECES = "filter(split(translate({0}, {1}, repeat(substr({1}, 1, 1), length({1}))), concat('\\\\Q', substr({1}, 1, 1), '\\\\E'), -1), x -> x <> '')"


def _strtok(args: list[str]) -> str:
    delimiters = args[1] if len(args) > 1 else "' '"
    nth = args[2] if len(args) > 2 else "1"
    return f"try_element_at({_PIECES.replace('{0}', args[0]).replace('{1}', delimiters)}, {nth})"


register("strtok", _strtok)
register("strtok_to_array", lambda a: f"to_json({_PIECES.replace('{0}', a[0]).replace('{1}', a[1] if len(a) > 1 else chr(39) + ' ' + chr(39))})")
templates("randstr", _1="randstr({0})", _2="randstr({0}, {1})")


def _digest(args: list[str]) -> str:
    how = constant(args[1]).lower()
    body = f"cast({args[0]} as binary)"
    return f"unhex(md5({body}))" if how == "md5" else f"unhex(sha2({body}, {int(how.removeprefix('sha'))}))"


def _encode(args: list[str]) -> str:
    how = constant(args[1]).lower()
    return f"lower(hex({args[0]}))" if how == "hex" else f"base64(cast({args[0]} as binary))" if how == "base64" else f"encode({args[0]}, {args[1]})"


register("digest", _digest)
register("encode", _encode)
templates("to_hex", _1="lower(hex({0}))")
templates("parse_ip", _2="tarn_parse_ip({0}, {1}, false)", _3="tarn_parse_ip({0}, {1}, {2} <> 0)")
templates("jarowinkler_similarity", _2="tarn_jaro_winkler({0}, {1})")
_IV_TAG = "hex(substr(c, 1, 12))"


def _encrypt(args: list[str]) -> str:
    value, key, iv = args[:3]
    aad = f", {args[3]}" if len(args) > 3 and args[3].strip().upper() != "NULL" else ""
    whole = f"aes_encrypt({value}, {key}, 'GCM', 'DEFAULT', {iv}{aad})"
    cut = f"to_json(named_struct('ciphertext', hex(substr(c, 13, length(c) - 28)), 'iv', {_IV_TAG}, 'tag', hex(substr(c, length(c) - 15, 16))))"
    return f"transform(array({whole}), c -> {cut})[0]"


def _decrypt(args: list[str]) -> str:
    text, key, iv = args[:3]
    aad = f", {args[3]}" if len(args) > 3 and args[3].strip().upper() != "NULL" else ""
    tag = f", {args[5]}" if len(args) > 5 else ""
    return f"aes_decrypt(concat({iv}, {text}{tag}), {key}, 'GCM', 'DEFAULT'{aad})"


register("encrypt_raw", _encrypt)
register("decrypt_raw", _decrypt)
