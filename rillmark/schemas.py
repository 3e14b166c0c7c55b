"""The row types of the data model: prompts, trajectories, tokens, tags, conversations."""

PROMPT = (
    "data_source string, prompt array<struct<role: string, content: string>>, ability string, "
    "reward_model struct<style: string, ground_truth: string>, extra_info struct<index: bigint, split: string>"
)
PREFERENCE = "prompt string, chosen string, rejected string"
CONVERSATION = "messages array<struct<role: string, content: string>>, tools string, enable_thinking boolean"
TRAJECTORY = (
    "uid string, session_id int, idx int, data_source string, prompt_len int, response_len int, seq_len int, global_steps bigint, "
    "min_global_steps bigint, max_global_steps bigint, mask array<int>, rewards array<double>, values array<double>, log_probs array<double>"
)
TOKEN = "uid string, traj bigint, pos int, mask int, reward double, value double, old_lp double, rollout_lp double, ref_lp double"
TAG = "partition_id string, key string, uid string, is_prompt boolean, status string, global_steps bigint, seq bigint"
METRIC = "step bigint, name string, value double, sample_count double"
