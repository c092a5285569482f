"""The REWARD job over rollout files as a generator writes them."""
