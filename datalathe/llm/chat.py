"""Preference formatting: two conversations that share their first turns become one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text around a turn: before the role, between role and text, after the text.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def format_preferences(turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role",
                       text_col: str = "text", learn: str = "assistant", template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """Rows of turns to one row for each pair: pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask,
    rejected_mask.

    pair: which pair a turn belongs to; chosen: whether it is of the chosen conversation (null: yes). The prompt is the
    longest common prefix of whole turns (role and text), rendered once. A completion is the rest of its conversation;
    its mask is an array of struct<length, learn> over the characters: only the texts of ``learn`` turns, with the
    closing mark, are learnt. Turns are in order of turn, then role, then text; repeated rows are repeated turns. A null
    role or text counts as empty, a null pair is a pair of its own. A pair with one side has an empty prompt and an empty
    other completion; equal conversations give a prompt and empty completions. No turns, no rows. Other columns are
    left out. One pair's turns meet in one row, as their rendering does; nothing else is gathered.
    """
    before, between, after = template
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
                    F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ours = F.coalesce(chosen, F.lit(True))
    pairs = turns.groupBy(pair.alias("pair_id")).agg(
        F.sort_array(F.collect_list(F.when(ours, turn))).alias("a"), F.sort_array(F.collect_list(F.when(~ours, turn))).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differ = F.array_position(same, False).cast("int")
    pairs = pairs.withColumn("n_prompt_turns", F.when(differ == 0, F.size("a")).otherwise(differ - 1))

    def rendered(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda t: F.concat(F.lit(before), t["role"], F.lit(between), t["text"], F.lit(after))), "")

    def rest(side: str) -> Column:
        return F.slice(side, F.col("n_prompt_turns") + 1, F.greatest(F.size(side) - F.col("n_prompt_turns"), F.lit(0)))

    def mask(side: str) -> Column:
        return F.flatten(F.transform(rest(side), lambda t: F.array(
            F.struct((F.char_length(t["role"]) + len(before) + len(between)).alias("length"), F.lit(False).alias("learn")),
            F.struct((F.char_length(t["text"]) + len(after)).alias("length"), (t["role"] == learn).alias("learn")))))

    return pairs.select("pair_id", "n_prompt_turns", rendered(F.slice("a", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
                        rendered(rest("a")).alias("chosen"), rendered(rest("b")).alias("rejected"),
                        mask("a").alias("chosen_mask"), mask("b").alias("rejected_mask"))
