"""caseloom.plans"""
